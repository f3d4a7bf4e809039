"""The registered queries over a small folder of tables, against brute force."""

import zlib
from collections import Counter

import pytest
from newsloom.llm import pii
from newsloom.llm.oracle import ORACLE
from newsloom.llm.queries import QUERIES

from .conftest import SCHEMA, corpus, prose
from .test_mix import size, wanted_targets
from .test_pairs import wanted_classes, wanted_lines, wanted_passages
from .test_texts import wanted_hits

ITEMS = [(3, prose(900, 70)), (7, "Only four words here"), (8, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with named, unique documents, in several files."""
    path = tmp_path_factory.mktemp("tables")
    docs = [r for r in corpus() if r[0] is not None]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(r[0], int(len(r[1] or "") > 20), 0) for r in docs[::2]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs


@pytest.fixture
def ran(spark, folder):
    path, docs = folder
    return lambda name: ([r.asDict() for r in QUERIES[name](spark, path).collect()], docs)


def test_op1(ran):
    got, docs = ran("op1_ngram_join")
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == wanted_classes(docs)


def test_op2(ran):
    got, docs = ran("op2_pii_pseudonyms")
    assert {r["doc_id"]: r["text"] for r in got if not any(r[f"n_{k}"] for k in pii.KINDS)}.items() <= {r[0]: r[1] for r in docs}.items()
    assert len(got) == len(docs)


def test_op3_and_op6(ran):
    got, docs = ran("op3_line_dedup")
    assert sorted(tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in got) == wanted_lines(docs)
    got, docs = ran("op6_substring_dedup")
    assert sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in got) == wanted_passages(docs, 50)


def test_op5(ran):
    got, docs = ran("op5_mix_sources")
    sizes = Counter()
    for _, text, _, source, _ in docs:
        sizes[source] += size(text)
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = wanted_targets(dict(sizes), weights)
    by = Counter()
    for r in got:
        assert (r["source_size"], r["target"]) == (sizes[r["source"]], pytest.approx(want[r["source"]]))
        assert r["taken"] <= 3 * r["size"]
        by[r["source"]] += r["taken"]
    assert all(abs(by[s] - want[s]) <= max(size(d[1]) for d in docs if d[3] == s) / 2 + 1 for s in sizes)


def test_op7(ran):
    got, docs = ran("op7_shard")
    text = {r[0]: (r[1] or "").encode() for r in docs}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in got)
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(docs) and max(counts.values()) - min(counts[s] for s in range(16)) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in counts.items())


def test_op8_and_op9(ran):
    got, docs = ran("op8_quality_lm")
    assert {r["doc_id"] for r in got} == {r[0] for r in docs}
    assert not any(r["kept"] for r in got if not r["n_words"])
    got, docs = ran("op9_quality_rules")
    assert all(r["kept"] is False for r in got if r["base_failed"]) and len(got) == len(docs)


def test_op10(ran):
    got, docs = ran("op10_decontaminate")
    short = [r for r in docs if len(r[1] or "") < 4000]
    want = wanted_hits(short, ITEMS)
    mine = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got}
    assert {d: mine[d] for d in want} == want and len(got) == len(docs)


def test_names_and_sql():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE) < set(QUERIES)
