"""Byte repeats, source audit and lexical search: against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from newsloom.llm import lexical_search, source_audit, suffix_dedup

from .conftest import SCHEMA, corpus, prose

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


# --- byte repeats -------------------------------------------------------------------

def wanted_bytes(table, width=50):
    lowest = -(1 << 63)
    least = {}
    texts = [(lowest if d is None else d, (t or "").encode()) for d, t, *_ in table]
    for d, t in texts:
        for i in range(len(t) - width + 1):
            s = t[i:i + width]
            least[s] = min(d, least.get(s, d))
    out = []
    for (d, t), row in zip(texts, table):
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if least[t[i:i + width]] < d:
                gone[i:i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = len([1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])])
        out.append((row[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found_bytes(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


@pytest.mark.parametrize("width,gram,bucket_bytes", [(50, 16, 1 << 22), (50, 16, 3000), (20, 20, 9000), (12, 1, 9000)])
def test_bytes(docs, width, gram, bucket_bytes):
    got = suffix_dedup.dedupe(docs, width=width, gram=gram, bucket_bytes=bucket_bytes)
    assert found_bytes(got) == wanted_bytes(corpus(), width)


def test_bytes_of_one_letter_and_cut_characters(rows):
    table = [(1, "a" * 60), (2, "b" + "a" * 200 + "c"), (3, "ab" * 60), (4, "x" + "ab" * 40), (5, "ü" * 60), (6, "é" + "ü" * 30 + "\0" * 70),
             (7, "\0" * 55), (2, "b" + "a" * 200 + "c"), (None, "z" * 99), (8, "z" * 99), (None, "z" * 99)]
    table = [(d, t, None, None, 0) for d, t in table]
    assert found_bytes(suffix_dedup.dedupe(rows(SCHEMA, table))) == wanted_bytes(table)


def test_bytes_edges(rows, none, crowded):
    assert suffix_dedup.dedupe(none).collect() == []
    assert found_bytes(suffix_dedup.dedupe(crowded)) == wanted_bytes(corpus())
    kept = {r["doc_id"]: r["text"] for r in suffix_dedup.apply(crowded).collect() if r["doc_id"] is not None}
    want = {r[0]: r[4] for r in wanted_bytes(corpus())}
    assert all(hashlib.sha256((t or "").encode()).hexdigest() == want[d] for d, t in kept.items())
    assert suffix_dedup.apply(crowded).columns == crowded.columns
    spans = [r for r in suffix_dedup.dedupe(crowded).collect() if r["n_spans"]]
    assert spans and all(sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_removed"] for r in spans)


def test_windows_of_pieces_are_those_of_the_text(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 2500)
    texts = [prose(1, 2000), "", None, prose(2, 30), prose(3, 900)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    seen = Counter()
    for data, bounds, rows, places in suffix_dedup.pieces(batch, 50):
        start, n, key, piece = suffix_dedup.minimizer_runs(data, bounds, 50, 16)
        for s, k, h, p in zip(start, n, key, piece):
            for i in range(k):
                seen[int(rows[p]), int(places[p] + s - bounds[p] + i)] += 1
                window = data[s + i:s + i + 50]
                alone = suffix_dedup.minimizer_runs(window, np.array([0, 50]), 50, 16)
                assert alone[2][0] == h                    # the window alone decides
    assert seen == Counter({(r, i): 1 for r, t in enumerate(texts) for i in range(max(len(t or "") - 49, 0))})


@pytest.mark.parametrize("seed,letters,depth", [(1, 2, 7), (2, 3, 12), (3, 20, 50), (4, 1, 5)])
def test_expansion_finds_common_prefixes(seed, letters, depth):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:letters]) for _ in range(rng.randrange(1, 80))).encode() for _ in range(40)]
    parts += [parts[3], parts[4] + parts[5]]
    text = np.frombuffer(b"\xff" + b"\xff".join(parts) + b"\xff", np.uint8)
    order = suffix_dedup.suffix_order(text, depth)
    circle = text.tobytes() * 3
    key = [circle[i:i + depth] for i in order]
    assert key == sorted(key)
    cut = suffix_dedup.expand(text, order, depth)
    for j in range(1, len(order)):
        same = key[j] == key[j - 1] and b"\xff" not in key[j]
        assert cut[j] == (not same)


# --- audit --------------------------------------------------------------------------

def wanted_audit(table, min_documents=10, top=10):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang, source, *_ in table:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = {w for w, c in docs[lang].items() if c >= min_documents}
        mine = {s: Counter({w: n for w, n in c.items() if w in kept}) for (x, s), c in groups.items() if x == lang}
        whole = sum(mine.values(), Counter())

        def share(counts, w):
            return 1 + 10**9 * (counts[w] + 2) // (sum(counts.values()) + 2 * len(kept))

        for s, c in mine.items():
            far = [(-sum((share(c, w) - share(o, w))**2 // (share(c, w) + share(o, w)) for w in kept), item.encode()) for item, o in mine.items() if item != s]
            more = [(-((share(c, w) - share(whole, w))**2 // (share(c, w) + share(whole, w))), w.encode()) for w in c if share(c, w) > share(whole, w)]
            for part, found, limit in (("pair", far, None), ("term", more, top)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(found)[:limit])]
    return sorted(out)


def common(seed=3):
    """Documents of few words, so that many are common; many sources in one language."""
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("Aa b ß ça d1e f-G hh i j k".split()) for _ in range(rng.randrange(0, 60))),
             rng.choice(["en", "de", None]), rng.choice([f"s{k}" for k in range(7)] + [None, ""]), 0) for i in range(200)]
    rows += [(1000 + i, f"word{i % 9} wörd{i % 4}", "many", f"src{i % 110}", 0) for i in range(330)]
    rows += [(9000, None, "lone", "s", 0), (9001, "", "pair", "x", 0), (9002, "a b", "pair", "Y", 0), (9003, "a b", "pair", "Y", 0)]
    return rows + rows[:30]


@pytest.mark.parametrize("block", [4096, 3])
def test_audit(rows, block):
    got = [tuple(r) for r in source_audit.audit(rows(SCHEMA, common()).repartition(3), block=block).collect()]
    assert sorted(got) == wanted_audit(common())


def test_audit_edges(docs, none, crowded):
    assert source_audit.audit(none).collect() == []
    assert sorted(tuple(r) for r in source_audit.audit(crowded).collect()) == wanted_audit(corpus())


def test_exact_shares():
    for count, size, v in [(0, 0, 1), (7, 10**14, 10**6), (10**15 // 3, 10**15, 5), (9, 9, 1)]:
        assert source_audit._shares(np.array([count]), size + 2 * v)[0] == 1 + 10**9 * (count + 2) // (size + 2 * v)


# --- search -------------------------------------------------------------------------

def wanted_ranks(table, items, top=10):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))

    docs = [(d, Counter(terms(t))) for d, t, *_ in table]
    docs = [(d, c) for d, c in docs if c]
    n, size = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in items:
        found = []
        for d, c in docs:
            m = 10 + 90 * sum(c.values()) * n // size
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
                        for w in set(terms(text)) if w in c)
            if score > 0:
                found.append((-score, -(1 << 63) if d is None else d))
        out += [(item, i + 1, None if d == -(1 << 63) else d, -s) for i, (s, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


ITEMS = [(3, prose(900, 70)), (7, "Only four words W5 w77 here"), (8, None), (9, ""), (3, prose(777, 150)), (None, "x y ünd w1 w2 w3"),
         (11, prose(5, 9000)), (12, "nothing-of-this zzz")]


@pytest.mark.parametrize("top,block_terms", [(10, 10**6), (3, 200)])
def test_ranks(docs, rows, top, block_terms):
    got = lexical_search.search(docs, rows("item_id long, text string", ITEMS), top=top, block_terms=block_terms)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == wanted_ranks(corpus(), ITEMS, top)


def test_ranks_with_ties_repeats_and_common_words(rows):
    rng = random.Random(2)
    table = [(i % 150, " ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randrange(0, 9))), None, None, 0) for i in range(300)]
    table += [(500, "a b c d e f g", None, None, 0)] * 20
    items = [(1, "a b c"), (2, "g"), (3, "a b c d e f g q"), (4, "q")]
    got = lexical_search.search(rows(SCHEMA, table).repartition(5), rows("item_id long, text string", items))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == wanted_ranks(table, items)


def test_rank_edges(docs, none, crowded, rows):
    items = rows("item_id long, text string, doc string", [(*i, "x") for i in ITEMS])
    assert lexical_search.search(none, items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []
    got = lexical_search.search(crowded, items)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == wanted_ranks(corpus(), ITEMS)
