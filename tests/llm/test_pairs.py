"""Near duplicates, shared lines, repeated passages: against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from newsloom.llm import components, line_dedup, ngram_join, runs, substring_dedup

from .conftest import corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOW))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def wanted_classes(table):
    sets = [(d, shingle_set(t)) for d, t, *_ in table]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for d, s in sets if d is not None)


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 3000])
def test_classes(docs, bucket_bytes):
    got = [tuple(r) for r in ngram_join.classes(docs, bucket_bytes=bucket_bytes).collect()]
    assert sorted(r for r in got if r[0] is not None) == wanted_classes(corpus())
    assert sorted(r[1:] for r in got if r[0] is None) == [(0, None), (56, None)]
    assert len(got) == len(corpus())


def test_prefix_join_alone_finds_all_links(docs, monkeypatch):
    """Without the light pass every link must come from the prefixes."""
    monkeypatch.setattr(ngram_join, "head_pairs", lambda units: units.select(
        units.doc.alias("a"), units.doc.alias("b")).limit(0))
    got = sorted(tuple(r) for r in ngram_join.classes(docs).collect() if r[0] is not None)
    assert got == wanted_classes(corpus())


@pytest.mark.parametrize("matches", [(1,), (1, 2, 4, 8), (1, 3)])
def test_any_prefix_lengths_are_exact(docs, monkeypatch, matches):
    monkeypatch.setattr(ngram_join, "MATCHES", matches)
    monkeypatch.setattr(ngram_join, "VERIFY_COST", 10**6)
    got = sorted(tuple(r) for r in ngram_join.classes(docs).collect() if r[0] is not None)
    assert got == wanted_classes(corpus())


def test_pairs_held_in_a_bucket_are_bounded(monkeypatch):
    """60 documents that all meet in three shingles: 1,770 pairs, each told once, some dozens at a time."""
    monkeypatch.setattr(ngram_join, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(ngram_join, "PLACES_AT_ONCE", 40)
    doc, prefix = np.arange(60), np.array([3, 5, 9], np.uint64).tobytes()
    units = pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(doc), pa.array(np.full(60, 3)), pa.array(np.full(60, 1, np.int32)), pa.array([prefix] * 60, pa.binary())],
        ["doc", "root", "n", "need", "prefix"])
    told = list(ngram_join._meet(1)((pa.scalar(0),), ngram_join._pack(1)(iter([units]))))
    assert max(batch.num_rows for batch in told) <= 50 + 40
    rows = [row for batch in told for row in batch.to_pylist()]
    assert sorted((r["a"], r["b"]) for r in rows) == [(a, b) for a in range(60) for b in range(a + 1, 60)]
    assert {r["shared"] for r in rows} == {3}


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 3000])
def test_bounded_buckets_find_all_links(docs, monkeypatch, bucket_bytes):
    monkeypatch.setattr(ngram_join, "PAIRS_AT_ONCE", 2)
    monkeypatch.setattr(ngram_join, "PLACES_AT_ONCE", 3)
    monkeypatch.setattr(ngram_join, "head_pairs", lambda units: units.select(
        units.doc.alias("a"), units.doc.alias("b")).limit(0))
    got = sorted(tuple(r) for r in ngram_join.classes(docs, bucket_bytes=bucket_bytes).collect() if r[0] is not None)
    assert got == wanted_classes(corpus())


def test_threshold_is_inclusive(rows):
    """Sets of 9 and 9 that share 8 are at exactly 0.8."""
    a = [f"t{i}" for i in range(13)]
    table = [(1, " ".join(a)), (2, " ".join(a[:12] + ["other"])), (3, " ".join(a[:11] + ["x", "y"])), (2, " ".join(a[:12] + ["other"]))]
    got = sorted(tuple(r) for r in ngram_join.classes(rows("doc_id long, text string", table)).collect())
    assert got == [(1, 9, 1), (2, 9, 1), (2, 9, 1), (3, 9, 3)]


def test_keep_one(crowded, none):
    kept = ngram_join.keep_one(crowded)
    assert kept.columns == crowded.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted({c for _, _, c in wanted_classes(corpus())})
    assert ngram_join.classes(none).collect() == []


def test_components(rows):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (100, 95), (90, 100)]
    got = {r["doc"]: r["root"] for r in components.components(rows("a long, b long", links)).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 90, 95: 90}
    assert components.components(rows("a long, b long", [])).collect() == []


# --- shared lines ---------------------------------------------------------------

def wanted_lines(table, min_chars=40, min_documents=5):
    holders = {}
    for d, t, *_ in table:
        for line in (t or "").split("\n"):
            key = line.strip(line_dedup.SPACES).translate(LOW)
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(-1 if d is None else d)
    out = []
    for d, t, *_ in table:
        kept = []
        lines = (t or "").split("\n")
        for line in lines:
            h = holders.get(line.strip(line_dedup.SPACES).translate(LOW), ())
            if len(h) < min_documents or max(h) == (-1 if d is None else d):
                kept.append(line)
        out.append((-1 if d is None else d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_line_digests(spark, docs, partitions):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in line_dedup.digests(docs).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == wanted_lines(corpus())
    assert any(r[2] for r in got)


def test_line_apply(crowded, none):
    out = line_dedup.apply(crowded, min_chars=10, min_documents=2)
    assert out.columns == crowded.columns and out.count() == len(corpus())
    want = {d: sha for d, _, _, sha in wanted_lines(corpus(), 10, 2) if d != -1}
    got = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in out.collect() if r["doc_id"]}
    assert got == want
    assert line_dedup.digests(none).collect() == []


def test_bitmaps_are_compressed_marks(docs):
    maps = line_dedup.bitmaps(docs, min_chars=10, min_documents=2).collect()
    lost = {d: n for d, _, n, _ in wanted_lines(corpus(), 10, 2) if n}
    assert {r["doc"]: int((~line_dedup.unpack(r["bitmap"], r["n_lines"])).sum()) for r in maps} == lost


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_runs_with_a_hot_key(spark, rows, keep):
    table = [(5, 0, d, p) for d in range(300) for p in range(2)] + [(k, 1, k, 0) for k in range(50)] + [(k, 1, k + 1, 0) for k in range(50)]
    found = runs.others(rows("h1 long, h2 long, doc long, pos int", table).repartition(7), 2, keep)
    got = sorted(tuple(r) for r in found.collect())
    head = (max if keep == "largest" else min)
    hot = head(range(300))
    want = [r for r in table if (r[1] == 0 and r[2] != hot) or (r[1] == 1 and r[2] != head(r[0], r[0] + 1))]
    assert got == sorted(want)


# --- repeated passages ------------------------------------------------------------

def wanted_passages(table, window):
    first, out = {}, []
    for d, t, *_ in table:
        words = WORD.findall(t or "")
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            d_ = -1 if d is None else d
            first[key] = min(first.get(key, d_), d_)
    for d, t, *_ in table:
        words, d_ = WORD.findall(t or ""), -1 if d is None else d
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i:i + window])] < d_:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((d_, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window,bucket_bytes", [(50, 1 << 30), (50, 2000), (10, 5000), (2, 1 << 20)])
def test_passages(docs, window, bucket_bytes):
    got = substring_dedup.dedupe(docs, window=window, bucket_bytes=bucket_bytes).drop("kept").collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == wanted_passages(corpus(), window)
    assert any(r["n_removed"] for r in got)


def test_passages_of_other_tables(crowded, none):
    out = substring_dedup.dedupe(crowded)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    for r in out.collect():
        assert (r["kept"] is None) == (r["n_removed"] == 0)
    assert substring_dedup.dedupe(none).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.dedupe(none, window=7)
