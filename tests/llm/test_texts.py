"""Operators on single texts: benchmark passages, licenses, rules, pseudonyms, language model."""

import hashlib
import math
import re
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
from newsloom.llm import decontamination, license_scan, pii, quality_lm, quality_rules
from newsloom.llm import words as wd
from pyspark.sql import functions as F

from .conftest import corpus, prose

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


# --- words ------------------------------------------------------------------------

def test_words_and_windows():
    import pyarrow as pa
    texts = ["One  two", None, "", "x" * 700, "ünd Straße\x0b7", "a b c d e f g", " lead trail "]
    got = wd.Words(pa.array(texts), wd.NOT_SPACE, lower=True)
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) for t in texts]
    cut = [got.data[a:b].tobytes().decode() for a, b in zip(got.start, got.end)]
    assert cut == [w for ws in want for w in ws] and list(got.counts) == [len(w) for w in want]
    h = got.hashes()
    assert len(set(h.tolist())) == len(set(cut))
    for k in (1, 2, 3, 5, 7):
        at, per_text = got.windows(k)
        assert list(per_text) == [max(0, len(w) - k + 1) for w in want]
        runs = [tuple(w[i:i + k]) for w in want for i in range(len(w) - k + 1)]
        assert len(set(wd.chain(h, k)[at].tolist())) == len(set(runs))


def test_hashes_do_not_depend_on_place():
    import pyarrow as pa
    rng = np.random.default_rng(3)
    vocabulary = ["w" * int(n) + str(i) for i, n in enumerate(rng.integers(1, 400, 60))]
    text = [" ".join(rng.choice(vocabulary, 500)) for _ in range(3)]
    got = wd.Words(pa.array(text), wd.NOT_SPACE, lower=False)
    pairs = {(got.data[a:b].tobytes(), int(h)) for a, b, h in zip(got.start, got.end, got.hashes())}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


# --- benchmark passages --------------------------------------------------------------

def wanted_hits(docs, items, window=13):
    out = {}
    for d, t, *_ in docs:
        words, hit, ids = words_of(t), set(), set()
        for item, text in items:
            w = words_of(text)
            size = min(window, len(w))
            for i in range(len(w) - size + 1 if w else 0):
                for j in range(len(words) - size + 1):
                    if words[j:j + size] == w[i:i + size]:
                        hit.update(range(j, j + size))
                        ids.add(str(item))
        out[d] = (len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
                  bool(hit) and 20 * len(hit) >= len(words))
    return out


def bench_and_docs():
    passage, short = prose(900, 70), "Only four words here"
    items = [(3, passage), (12, "x. " + prose(51, 30)), (7, short), (8, None), (9, ""), (10, "?! ."), (3, passage),
             (20, prose(5, 9000)[500:900])]
    docs = [r for r in corpus() if r[0] is not None and len(r[1] or "") < 4000]
    docs += [(5001, f"ab {short}, cd", "en", "s", 1), (5002, prose(51, 30)[:60], "en", "s", 1), (5003, short.upper() + "!", "en", "s", 1),
             (5004, prose(5, 9000)[300:2500], "en", "s", 1)]
    return items, docs


@pytest.mark.parametrize("block", [500_000, 60])
def test_contamination(rows, block):
    items, docs = bench_and_docs()
    table = rows("doc_id long, text string, lang string, source string, n_chars long", docs).repartition(3)
    bench = rows("item_id long, text string", items)
    got = decontamination.judge(table.withColumnRenamed("doc_id", "row_id"), bench, block_words=block).collect()
    want = wanted_hits(docs, items)
    assert {r["row_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got} == want
    assert sum(w[4] for w in want.values()) > 5


def test_longest_matches(rows):
    passage = prose(900, 70)
    docs = rows("row_id long, text string", [(1, f"x y {passage} z"), (2, " ".join(passage.split()[5:25])), (3, None)])
    got = {r["row_id"]: r for r in decontamination.find(docs, rows("item_id long, text string", [(1, passage)])).collect()}
    assert (got[1]["starts"], got[1]["ends"], got[1]["longest"]) == ([2], [72], 70)
    assert (got[2]["starts"], got[2]["ends"], got[3]["longest"]) == ([0], [20], 0)


def test_remove_contaminated(rows, crowded, none, monkeypatch):
    items, _ = bench_and_docs()
    bench = rows("item_id long, text string", items)
    want = sorted(d for d, w in wanted_hits([r for r in corpus() if len(r[1] or "") < 4000], items).items() if d and not w[4])
    big = {r[0] for r in corpus() if len(r[1] or "") >= 4000}
    for limit in (decontamination.BLOCK_WORDS, 100):
        out = decontamination.remove(crowded, bench, block_words=limit)
        assert out.columns == crowded.columns
        assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] and r["doc_id"] not in big) == want
    assert decontamination.remove(none, bench).collect() == []
    assert decontamination.remove(crowded, bench.limit(0)).count() == crowded.count()


def test_rows_with_equal_or_null_ids_stay(rows):
    passage, other = prose(900, 70), prose(901, 70)
    table = [(1, f"x {passage}"), (1, "clean text"), (None, f"y {other}"), (None, None)]
    docs, bench = rows("row_id long, text string", table), rows("item_id long, text string", [(1, passage), (2, other)])
    want = sorted([(1, 71, 70, True), (1, 2, 0, False), (None, 71, 70, True), (None, 0, 0, False)], key=str)
    for limit in (500_000, 40):
        got = decontamination.judge(docs, bench, block_words=limit).collect()
        assert sorted([(r["row_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in got], key=str) == want
        assert sorted(r["text"] for r in decontamination.remove(docs, bench, block_words=limit).collect() if r["text"]) == ["clean text"]


def test_repeats_on_both_sides_stay_small():
    import tracemalloc
    bench = decontamination.Benchmark(pa.table({"item_id": ["7", "8"], "text": ["a " * 2000, "b a a " * 300]}), 13)
    batch = pa.RecordBatch.from_pydict({"row_id": [1, 2], "text": ["a " * 200_000, "x " + "b a a " * 500]})
    tracemalloc.start()
    (found,) = decontamination._search(bench)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = found.to_pylist()
    assert [r["n_words"] for r in rows] == [200_000, 1501] and [r["longest"] for r in rows] == [2000, 900]
    assert set(rows[0]["item_ids"]) == {"7"} and set(rows[1]["item_ids"]) == {"8"}
    assert peak < 1 << 30


def test_suffix_array_is_sorted_and_searched():
    rng = np.random.default_rng(1)
    hashes = rng.choice(rng.integers(0, 2**64, 6, dtype=np.uint64), 400)
    array = decontamination.SuffixArray(hashes)
    code = np.minimum((hashes >> np.uint64(48)) + np.uint64(1), np.uint64(65535)).tolist() + [0] * 40
    keys = [tuple(code[i:i + decontamination.DEPTH]) for i in array.order]
    assert keys == sorted(keys) and sorted(array.order.tolist()) == list(range(400))


# --- licenses ------------------------------------------------------------------------

def test_license_places(rows, none, docs):
    mit = license_scan.NOTICES["mit"].split()
    texts = [
        "This is under the GNU General Public\nLicense, version 3.", "Apache License apache-license! MIT License",
        "cc by cc-by-nc ccby CC\tBY", None, "", "gnu general public", "apache licenses",
        "Intro words. " + " ".join(mit[:20] + ["inserted", "noise"] + mit[20:]) + " end",
        " ".join(mit[:10]), "mit license " * 300, "Redistribution and use in source and binary forms, with or without "
        "modification, are permitted provided that the following conditions are met:",
    ]
    table = rows("doc_id long, text string, key string, template int", [(i, t, "k", 1) for i, t in enumerate(texts)] + [(0, texts[0], "k", 1)])
    got = {r["doc_id"]: r for r in license_scan.summary(license_scan.scan(table)).collect()}
    for i, t in enumerate(texts):
        words, places = words_of(t), []
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            places += [(a, label) for a in range(len(words)) if words[a:a + len(p)] == p]
        starts = [a for a, _ in places]
        want = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        assert tuple(got[i])[1:6] == want, t
        assert 0 <= got[i]["score"] <= 1 and (not places or got[i]["score"] == 1)
    assert got[7]["labels"] == "mit" and 0.9 < got[7]["score"] <= 1 and got[7]["n_base"] == 0
    assert got[8]["labels"] == "" and "bsd" in got[10]["labels"]
    spans = {r["doc_id"]: r for r in license_scan.scan(table).collect()}[7]
    assert spans["starts"] == [2] and spans["ends"] == [2 + len(mit) + 2]
    assert license_scan.scan(none).collect() == []
    assert license_scan.summary(license_scan.scan(docs)).count() == len(corpus())


# --- quality rules ----------------------------------------------------------------------

def wanted_figures(text):
    body = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", body)
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    again = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in body.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", body)), len(lines) - len(set(lines)), len(again),
            n < 50 or 100 * len(again) > 50 * n)


def test_rule_figures(rows, docs, none, crowded):
    texts = ["", None, "a", "a b", "a b c a b c", "a a a a a", "x # y\n\n x # y\nx # y", "tab\tsep\x0bcol\x0c$%&|<>*",
             "a b c d " * 20, "one two\n one two\none two", "\n".join(["same line"] * 4), " ".join(map(str, range(60)))]
    got = {r["i"]: tuple(r)[1:] for r in quality_rules.figures(rows("i int, text string", list(enumerate(texts)))).drop("text").collect()}
    assert got == {i: wanted_figures(t) for i, t in enumerate(texts)}
    whole = quality_rules.judge(docs.filter("length(text) < 5000 or text is null")).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    texts = {r[0]: r[1] for r in corpus() if r[0] is not None}
    assert all(tuple(r[c] for c in names) == wanted_figures(texts[r["doc_id"]]) for r in whole if r["doc_id"] is not None)
    assert quality_rules.judge(none).collect() == []
    assert quality_rules.judge(crowded).count() == len(corpus())


def test_shared_lines_reject(rows):
    own = [prose(i, 60) for i in range(8)]
    shared = prose(99, 70)
    table = [(i, "h", f"{t}\n{shared}") for i, t in enumerate(own)] + [(50 + i, "h", own[0]) for i in range(8)] + [(90, "other", f"{own[1]}\n{shared}"), (91, None, own[2])]
    got = {r["doc_id"]: r for r in quality_rules.judge(rows("doc_id long, source string, text string", table), min_documents=5).collect()}
    assert all(not got[i]["kept"] and got[i]["removed_words"] == 70 for i in range(1, 8))
    # The first text stands in nine documents, so its own line is a common one too.
    assert got[0]["removed_words"] == 130
    assert all(not got[i]["kept"] and got[i]["removed_words"] == 60 for i in range(50, 58))
    assert all(got[i]["kept"] and got[i]["removed_words"] == 0 for i in (90, 91))


def test_a_page_crawled_often_is_boilerplate(rows):
    table = [(i, "h", prose(7, 80)) for i in range(3000)] + [(5000 + i, "h", prose(100 + i, 80)) for i in range(40)]
    got = quality_rules.judge(rows("doc_id long, source string, text string", table)).collect()
    assert {(r["doc_id"] < 5000, r["kept"], r["removed_words"]) for r in got} == {(True, False, 80), (False, True, 0)}


def test_shared_lines_are_taken_out(rows):
    own, shared = [prose(i, 90) for i in range(8)], prose(99, 40)
    table = [(i, "h", f"{t}\n\n {shared.upper()}\n{own[7 - i]}\n{shared}", "x") for i, t in enumerate(own)]
    table += [(0, *table[0][1:]), (90, "other", f"{own[1]}\n{shared}", "x"), (91, None, own[2], "x"), (92, "h", f"{own[3]}\n", "x"), (93, "h", shared, "x"), (94, "h", None, "x")]
    docs = rows("doc_id long, source string, text string, kept string", table)
    got = quality_rules.apply(docs, min_documents=5)
    assert got.columns == docs.columns
    want = [(i, h, f"{own[i]}\n\n{own[7 - i]}" if i < 8 else t, x) for i, h, t, x in table if i < 93]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# --- pseudonyms ---------------------------------------------------------------------------

def luhn(digits):
    d = [int(x) for x in digits[::-1]]
    return sum(d[::2] + [x * 2 - 9 if x > 4 else x * 2 for x in d[1::2]]) % 10 == 0


def test_pseudonyms_keep_format_and_go_back(rows):
    texts = ["pay 4111 1111 1111 1111 or 4111-1111-1111-1111, 4111111111111111.", "+1 (017) 555-7713 (212) 555-0100 call",
             "10.0.0.1 and 300.1.1.1, 01.2.3.4", "2024-02-29 2023-02-30 31/12/1999 01.02.2003 1899-12-31", "123-45-6789 666-12-3456 000-11-2222",
             "4111111111111112 12345 2024-13-01", None, "", "plain", "v1.2.3.4 a4111111111111111 4111111111111111b", "5500005555555559 " * 50]
    table = rows("id int, text string, n_card string", [(i, t, "x") for i, t in enumerate(texts)])
    new = pii.pseudonymize(table, "secret")
    got = {r["id"]: r for r in new.collect()}
    out = [got[i]["text"] for i in range(len(texts))]
    shape = lambda t: re.sub(r"[0-9]", "9", t or "")
    assert [shape(a) for i, a in enumerate(out) if i != 2] == [shape(b) for i, b in enumerate(texts) if i != 2]
    cards = re.findall(r"[0-9](?:[ -]?[0-9]){15}", out[0])
    assert len({re.sub("[ -]", "", c) for c in cards}) == 1 and all(luhn(re.sub("[ -]", "", c)) for c in cards)
    assert re.sub("[ -]", "", cards[0]) != "4111111111111111"
    assert out[5:10] == texts[5:10] and "300.1.1.1" in out[2] and "01.2.3.4" in out[2] and "10.0.0.1" not in out[2]
    assert "2023-02-30" in out[3] and "1899-12-31" in out[3] and "666-12-3456" in out[4]
    assert [tuple(got[i][f"n_{k}"] for k in pii.KINDS) for i in (0, 1, 2, 3, 4, 6)] == [
        (3, 0, 0, 0, 0, 0), (0, 0, 0, 0, 2, 0), (0, 0, 0, 1, 0, 0), (0, 3, 0, 0, 0, 0), (0, 0, 0, 0, 0, 1), (0, 0, 0, 0, 0, 0)]
    back = pii.pseudonymize(new, "secret", back=True)
    assert [r["text"] for r in back.orderBy("id").collect()] == texts
    other = pii.pseudonymize(table, "another").orderBy("id").collect()
    assert other[0]["text"] != out[0]


def feistel(left, right, a, b, key, kind):
    """The permutation by its definition."""
    for i in range(1, pii.ROUNDS + 1):
        value, modulus = (right, a) if i % 2 else (left, b)
        mac = hashlib.sha256("|".join((key, kind, str(i), str(value), key)).encode()).hexdigest()
        moved = int(mac[:15], 16) % modulus
        left, right = ((left + moved) % a, right) if i % 2 else (left, (right + moved) % b)
    return left, right


def iban_ok(text):
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_more_formats(rows):
    texts = ["01/31/2024 12/25/1990 02/29/2024 02/29/1999", "2024/01/31 2024/13/01", "31 Jan 2024 and 30 Feb 2024",
             "3782 822463 10005 and 378282246310005", "212.555.0100, 1-800-555-0199 (212)555-0100",
             "DE89 3704 0044 0532 0130 00 DE89370400440532013000 GB82WEST12345698765432 DE88370400440532013000"]
    table = rows("id int, text string", list(enumerate(texts)))
    new = pii.pseudonymize(table, "secret")
    got = new.orderBy("id").collect()
    out = [r["text"] for r in got]
    assert [tuple(r[f"n_{k}"] for k in ("date", "card", "phone", "iban")) for r in got] == [
        (3, 0, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0), (0, 2, 0, 0), (0, 0, 3, 0), (0, 0, 0, 3)]
    months = [d.split("/") for d in out[0].split()]
    assert all(int(m) <= 12 < int(d) for m, d, _ in months) and out[0].split()[3] == "02/29/1999"
    assert months[2][:2] == ["02", "29"] and int(months[2][2]) % 4 == 0
    cards = re.findall("[0-9 ]{15,}", out[3].replace(" and ", ";"))
    assert cards[0].replace(" ", "") == cards[1] != "378282246310005" and luhn(cards[1])
    ibans = re.findall(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4})+(?: ?[A-Z0-9]{2})?", out[5])
    assert ibans[0].replace(" ", "") == ibans[1] != "DE89370400440532013000" and all(map(iban_ok, ibans[:3])) and ibans[2][4:8] == "WEST"
    assert out[5].endswith("DE88370400440532013000")
    assert [r["text"] for r in pii.pseudonymize(new, "secret", back=True).orderBy("id").collect()] == texts
    first, days = date(1900, 1, 1), [0, 5, 45_321, 73_048]
    moved = [feistel(n // 319, n % 319, 229, 319, "secret", "date") for n in days]
    one = pii.pseudonymize(rows("text string", [(" ".join((first + timedelta(n)).isoformat() for n in days),)]), "secret").head()
    assert one["text"].split() == [(first + timedelta(a * 319 + b)).isoformat() for a, b in moved]
    empty = pii.pseudonymize(table.limit(0), "secret")
    assert empty.collect() == [] and empty.columns == new.columns


def test_pseudonyms_in_timestamps_urls_and_paths(rows):
    texts = ["2024-01-31T10:00:00Z and 2024-01-31", "http://10.0.0.1/x 10.0.0.1", "10.0.0.1/24 10.0.0.1/2024", "/logs/2024-01-31/a-2024-01-31.txt 2024-01-31/2024-02-01",
             "ip-10.0.0.1", "2024-01-31Tx 12-2024-01-31 1.2024-01-31 -2024-01-31 1.10.0.0.1 10.0.0.1-5 v.1.2.3.4"]
    table = rows("id int, text string", list(enumerate(texts)))
    new = pii.pseudonymize(table, "secret")
    got = {r["id"]: r for r in new.collect()}
    assert [(got[i]["n_date"], got[i]["n_ip"]) for i in range(6)] == [(2, 0), (0, 2), (0, 2), (4, 0), (0, 1), (0, 0)]
    day = re.findall(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", " ".join(got[i]["text"] for i in (0, 3)))
    assert len(set(day[:-1])) == 1 and day[0] != "2024-01-31" and got[0]["text"].startswith(f"{day[0]}T10:00:00Z")
    addresses = {a for i in (1, 2, 4) for a in re.findall(r"[0-9]+(?:\.[0-9]+){3}", got[i]["text"])}
    assert len(addresses) == 1 and addresses != {"10.0.0.1"}
    assert [r["text"] for r in pii.pseudonymize(new, "secret", back=True).orderBy("id").collect()] == texts


def test_feistel_is_a_permutation(spark):
    pair = pii.feistel(F.floor(F.col("id") / 7), F.col("id") % 7, F.lit(11), F.lit(7), F.lit("k"), "t")
    got = {(r["left"], r["right"]) for r in spark.range(77).select(pair.alias("p")).select("p.*").collect()}
    assert got == {(a, b) for a in range(11) for b in range(7)}


def test_all_days_stay_days(rows, spark):
    days = spark.range(0, pii.DAYS, 37).select("id", F.date_format(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    got = [r["text"] for r in pii.pseudonymize(days, "k").filter("n_date = 1").collect()]
    assert len(got) == len(set(got)) == days.count() and all("1900" <= d[:4] <= "2099" for d in got)


# --- language model ----------------------------------------------------------------------

def model_texts():
    texts = [(i, prose(i, 60, 50), "en") for i in range(40)] + [(100 + i, prose(i, 60, 50) + " tail", "de") for i in range(3)]
    return texts + [(200, "zz qq vv " * 30, "en"), (201, None, "en"), (202, "", None), (203, "w1", "en"), (204, "x" * 5000, "en"), (0, prose(0, 60, 50), "en")]


@pytest.mark.parametrize("size,shard,stream", [(65_534, 1 << 30, 1 << 30), (20, 9, 40)])
def test_log_probabilities(rows, size, shard, stream):
    """Against the textbook formulas on counts in dictionaries."""
    from collections import Counter
    table, good = model_texts(), list(range(30))
    docs = rows("doc_id long, text string, lang string", table)
    got = {r["doc_id"]: r for r in quality_lm.scores(
        docs, rows("id long", [(i,) for i in good]), vocabulary_size=size, shard_bigrams=shard, stream_bytes=stream).collect()}
    token = lambda t: [w[:-1] if len(w) > 1 and w[-1] in ".,;:!?" else w for w in (t or "").lower().split()]
    trained = [t for i, t, _ in table if i in good]
    freq = Counter(w for t in trained for w in token(t))
    known = {w for w, n in freq.items() if n >= quality_lm.MIN_COUNT}
    if size < len(known):          # which of equally frequent words stay is a matter of hashes
        top = sorted((n for n in freq.values()), reverse=True)
        pytest.skip("ties") if top[size - 1] == top[size] else None
        known = {w for w, n in freq.items() if n >= top[size - 1]}
    number = lambda t: ["<s>", *[w if w in known else None for w in token(t)]]
    pairs = Counter(p for t in trained for p in zip(number(t), number(t)[1:]))
    total, follow, before = Counter(), {}, Counter()
    for (a, b), n in pairs.items():
        total[a] += n
        follow.setdefault(a, []).append(n)
        before[b] += 1
    d = quality_lm._discounts(np.bincount([min(n, 5) for n in pairs.values()], minlength=6))
    low = quality_lm._discounts(np.bincount([min(n, 5) for n in before.values()], minlength=6))
    kinds = sum(before.values())
    rest = sum(low[min(n, 3)] for n in before.values()) / kinds
    others = max(len(freq) - len(known), 1)

    def p(a, b, minus):
        lower = max(before[b] - low[min(before[b], 3)], 0) / kinds + rest / (quality_lm.WORDS - 1)
        n = max(pairs[a, b] - minus, 0)
        back = sum(d[min(x, 3)] for x in follow[a]) / total[a] if total[a] else 1.0
        return (max(n - d[min(n, 3)], 0) / max(total[a], 1) + back * lower) * (1 / others if b is None else 1)

    for i, t, _ in table[:-1]:
        own = Counter(zip(number(t), number(t)[1:]))
        want = sum(n * math.log(p(a, b, n if i in good else 0)) for (a, b), n in own.items())
        times = 2 if i == 0 else 1     # the repeated row doubles both sums
        assert got[i]["n"] == times * sum(own.values())
        if own:
            assert got[i]["log_p"] == pytest.approx(times * want, rel=1e-9)


def test_probabilities_sum_to_one(rows):
    import pyarrow as pa
    facts = {"total": {0: 3, 5: 9}, "n1": {0: 1, 5: 2}, "n2": {0: 1, 5: 1}, "n3": {5: 1}, "before": {5: 3, 6: 2, 1: 1}, "counts": {1: 3, 2: 2, 3: 0, 5: 1}}
    flat = [(k, w, v) for k, t in facts.items() for w, v in t.items()]
    model = quality_lm.Model(pa.table({"kind": [f[0] for f in flat], "word": pa.array([f[1] for f in flat], pa.int32()), "value": [f[2] for f in flat]}), 1)
    bigram = (np.uint32(5) << np.uint32(16)) | np.arange(1, quality_lm.WORDS, dtype=np.uint32)
    count = np.zeros(len(bigram), np.int64)
    count[:4] = [1, 1, 2, 5]
    assert np.exp(model.log_p(bigram, count)).sum() == pytest.approx(1)


def test_every_frequent_word_is_in_the_vocabulary(rows):
    """70,000 words, each seen three times behind the same word: no text is less likely than another."""
    texts = [" ".join(f"v{i}" for i in range(n, n + 500)) for n in range(0, 70_000, 500)]
    table = [(1000 * copy + i, t, "en") for copy in range(4) for i, t in enumerate(texts)]
    trusted = rows("id long", [(i,) for i, *_ in table if i < 3000])
    got = [r["log_p"] for r in quality_lm.scores(rows("doc_id long, text string, lang string", table), trusted).filter("not trusted").collect()]
    assert len(got) == len(texts) and max(got) - min(got) < 1e-6


def test_small_languages_have_their_own_bounds(rows):
    """Few trusted documents pull the bounds of their language, more of them pull further."""
    table = [(i, prose(i, 60, 50), "en") for i in range(100)]
    table += [(1000 + 100 * k + i, " ".join(f"{lang}{j}" for j in range(60)), lang)
              for k, (lang, n) in enumerate((("de", 5), ("fr", 45))) for i in range(n)] + [(2000, prose(5, 60, 50), "xx")]
    trusted = rows("id long", [(i,) for i, _, lang in table if lang != "xx"])
    got = {r["lang"]: r["high"] - r["low"] for r in quality_lm.classify(rows("doc_id long, text string, lang string", table), trusted).collect()}
    assert got["fr"] < got["de"] < got["xx"]


def test_classifier(rows, none):
    table = model_texts()
    docs = rows("doc_id long, text string, lang string", table)
    trusted = rows("id long, note string", [(i, "x") for i in range(30)])
    got = {r["doc_id"]: r for r in quality_lm.classify(docs, trusted, min_trusted=10).collect()}
    assert not any(got[i]["kept"] for i in (200, 201, 202)) and got[203]["kept"]
    assert sum(got[i]["kept"] for i in range(40)) >= 38
    assert got[100]["low"] == got[5]["low"]            # too few of its language: bounds of all
    kept = quality_lm.keep(docs, trusted, min_trusted=10)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(
        i for i, *_ in table if got[i]["kept"])
    assert quality_lm.classify(none, trusted).collect() == []
    untrained = quality_lm.classify(docs, trusted.limit(0)).collect()
    assert all(r["kept"] == (r["n_words"] > 0) for r in untrained)
