"""Keyword tables, stored indexes of kept news, approximate options, expiring state."""

import glob
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom import session
from newsloom.functions import text as tx
from newsloom.operators import approximate, dedup, ingest, keywords
from newsloom.sources import known, tables, vectors
from newsloom.streaming import refresh


def plan_of(df):
    return df._jdf.queryExecution().toString()


# --- keywords ---------------------------------------------------------------------

def test_keyword_matches(rows):
    rng = random.Random(1)
    texts = [(i % 50, "".join(rng.choice("aAbc é") for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    texts += [(90, None), (91, ""), (92, "Straße " * 20), (93, "abcabcabcabc")]
    words = ["a", "ab", "é", "bca", "aab c", "straße", "abcabcabc", "STRASSE", "zzz", "", None, "ab", "c é a", "b" * 9]
    got = keywords.keyword_matches(rows("id int, text string", texts).repartition(3), rows("keyword string", [(w,) for w in words]), "id", "text")
    want = [(i, w) for i, t in texts for w in {w.lower() for w in words if w} if t and w in t.lower()]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_keyword_table_stays_out_of_the_plan(spark, rows):
    texts = rows("id int, text string", [(i, f"some words number{i} here") for i in range(300)])
    table = spark.range(20_000).select(F.concat(F.lit("number"), "id").alias("keyword"))
    got = keywords.keyword_counts(texts, table, "id", "text")
    plan = plan_of(got)
    assert "number123" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    found = {r["keyword"]: r["n"] for r in got.collect()}
    assert found["number299"] == 1 and found["number2"] == 111 and len(found) == 300
    none = rows("keyword string", [])
    assert keywords.keyword_counts(texts, none, "id", "text").collect() == []
    assert keywords.keyword_counts(texts.limit(0), table, "id", "text").collect() == []


def test_texts_and_their_grams_are_not_shuffled(rows, monkeypatch):
    """Words verified a few at a time; what leaves a task are the keywords that it found."""
    monkeypatch.setattr(keywords, "WORDS_AT_ONCE", 3)
    monkeypatch.setattr(keywords, "PLACES_AT_ONCE", 5)
    rng = random.Random(3)
    texts = [(i if i else None, " ".join(f"word{rng.randrange(40)}x{rng.randrange(3)}" for _ in range(30))) for i in range(40)]
    words = sorted({w[:n] for _, t in texts for w in t.split() for n in (3, 6, 7, 8, 20)}) + ["x0 word1", "word1x0 word1x1", "wordless"]
    got = keywords.keyword_counts(
        rows("id int, text string", texts).repartition(3), rows("keyword string", [(w,) for w in words]), "id", "text")
    plan = plan_of(got)
    assert "Join" not in plan and "hashpartitioning(id" not in plan
    want = {w: sum(w in t for i, t in texts if i is not None) for w in words}
    assert {r["keyword"]: r["n"] for r in got.collect()} == {w: n for w, n in want.items() if n}


def test_tables_of_many_parts_are_not_shuffled(spark, rows, tmp_path):
    from newsloom.sources import samples

    spark.range(4000).repartition(40).write.parquet(f"{tmp_path}/many.parquet")
    spark.range(4000).coalesce(1).write.parquet(f"{tmp_path}/one.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    try:
        many, one = (samples.table(spark, str(tmp_path), name) for name in ("many", "one"))
        assert "Exchange" not in plan_of(many) and "Exchange" in plan_of(one)
        assert many.count() == one.count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


# --- stored posting index ------------------------------------------------------------

def word_sets(n, seed):
    """Texts in groups that overlap more or less."""
    rng = random.Random(seed)
    base = [[f"word{rng.randrange(3000)}" for _ in range(rng.randrange(8, 40))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"word{rng.randrange(3000)}"
        out.append((i, " ".join(words) if i % 37 else "a b c"))
    return out


def greedy(rows, same):
    kept = []
    return {i for i, x in rows if not any(same(x, y) for y in kept) and (kept.append(x) or True)}


def alike(a, b):
    a, b = ({w for w in t.split() if len(w) > 3} for t in (a, b))
    return bool(a and b) and 100 * len(a & b) >= 82 * len(a | b)


def test_runs_against_the_posting_index(spark, rows, tmp_path):
    data = word_sets(160, 5)
    store = tables.Store(spark, f"{tmp_path}/db", 8).create()
    kept = set()
    for run, part in enumerate((data[:60], data[60:61], data[61:])):
        flags, n = known.lexical_run(store, rows("news_id int, full_text string", part), f"b{run}", ord_col="news_id")
        mine = {r["news_id"] for r in flags.filter("kept").collect()}
        assert flags.count() == len(part) and n == len(mine)
        kept |= mine
    assert kept == greedy(data, alike) and len(kept) < 140
    again, _ = known.lexical_run(store, rows("news_id int, full_text string", data[61:]), "b2", ord_col="news_id")
    assert {r["news_id"] for r in again.filter("kept").collect()} == {i for i in kept if i > 60}
    assert store.read("fingerprints").count() == len(kept)


def size_of(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True))


def spoil(paths):
    for folder in paths:
        for f in glob.glob(f"{folder}/*.parquet"):
            with open(f, "wb") as out:
                out.write(b"not a table")


def test_one_row_reads_only_the_buckets_of_its_words(spark, rows, tmp_path):
    store = tables.Store(spark, f"{tmp_path}/db", 32).create()
    schema = "news_id int, full_text string"
    known.lexical_run(store, rows(schema, word_sets(200, 3)), "b0", ord_col="news_id")
    one = rows(schema, [(1000, "alpha beta gamma delta words here")])
    prints = dedup.fingerprints(one, "news_id", "full_text", "news_id").drop("ord")
    keys = known.keys_of(prints, known.word_order(store, prints, "x"), 82)
    touched = {r[0] for r in keys.select(known.bucket_of(store, F.col("word"))).distinct().collect()}
    assert 0 < len(touched) < 8
    plan = plan_of(known.postings_of(store, keys, "x"))
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    folders = set(glob.glob(f"{store.path('postings')}/batch_id=b0/bucket=*"))
    spoil(f for f in folders if int(f.rsplit("=", 1)[1]) not in touched)
    spoil(glob.glob(f"{store.path('fingerprints')}/batch_id=b0/*"))         # nothing is met, so no word set is read
    flags, _ = known.lexical_run(store, one, "b1", ord_col="news_id")
    assert [r["kept"] for r in flags.collect()] == [True]


def test_bytes_written_do_not_grow_with_the_history(spark, rows, tmp_path):
    sizes = []
    for n in (20, 400):
        store = tables.Store(spark, f"{tmp_path}/db{n}", 4).create()
        known.lexical_run(store, rows("news_id int, full_text string", word_sets(n, 3)), "b0", ord_col="news_id")
        late = rows("news_id int, full_text string", [(5000 + i, f"fresh{i} text{i} about{i} things{i}") for i in range(5)])
        known.lexical_run(store, late, "b1", ord_col="news_id")
        sizes.append(sum(size_of(f"{store.path(t)}/batch_id=b1") for t in ("postings", "fingerprints")))
    assert sizes[1] <= 1.1 * sizes[0]


# --- stored vector index ----------------------------------------------------------------

def points(n, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n // 5, 6))
    data = centers[rng.integers(0, len(centers), n)] + rng.normal(scale=0.12, size=(n, 6))
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(data)]


def near(a, b):
    return float(((np.float64(a) - np.float64(b)) ** 2).sum()) < 0.18


def test_runs_against_the_vector_index(spark, rows, tmp_path):
    data = points(300, 4)
    schema = "news_id int, embedding array<float>"
    store = tables.Store(spark, f"{tmp_path}/db", 8).create()
    kept, pivots = set(), []
    for run, part in enumerate((data[:40], data[40:41], data[41:200], data[200:])):
        flags, n = vectors.semantic_run(store, rows(schema, part), f"b{run}", ord_col="news_id", cell_rows=8)
        mine = {r["news_id"] for r in flags.filter("kept").collect()}
        assert flags.count() == len(part) and n == len(mine)
        kept |= mine
        pivots.append(vectors._generation(store)[1:])
        gen = vectors._generation(store)[0]
        assert store.read("vector_cells").filter(F.col("gen") == gen).count() == store.read("embeddings").count() == len(kept)
    assert kept == greedy(data, near) and len(kept) < 250
    counts = [sum(len(b) for b in p.below) for _, p in pivots]
    assert counts[0] < counts[-1] and all(c >= made // 8 for c, (made, _) in zip(counts, pivots))
    vectors.semantic_run(store, rows(schema, data[200:]), "b3", ord_col="news_id", cell_rows=8)
    assert store.read("embeddings").count() == len(kept)


def test_one_vector_reads_only_the_cells_it_reaches(spark, rows, tmp_path):
    schema = "news_id int, embedding array<float>"
    store = tables.Store(spark, f"{tmp_path}/db", 8).create()
    spread = [(i, [float(10 * (i % 10)), float(10 * (i // 10)), 0.0]) for i in range(100)]
    vectors.semantic_run(store, rows(schema, spread), "b0", ord_col="news_id", cell_rows=2)
    gen, _, pivots = vectors._generation(store)
    one = rows("id int, embedding array<float>", [(900, [40.0, 40.1, 0.1])])
    keys = dedup.cells(one, pivots, 0.18**0.5)
    touched = {r["top"] for r in keys.collect()}
    folders = glob.glob(f"{store.path('vector_cells')}/gen={gen}/batch_id=b0/top=*")
    assert len(touched) < len(folders)
    assert "PartitionFilters" in plan_of(vectors.cells_of(store, keys, gen, "x"))
    spoil(f for f in folders if int(f.rsplit("=", 1)[1]) not in touched)
    assert [r["id"] for r in vectors.matching(store, one, "x").collect()] == [900]


@pytest.mark.parametrize("count", [1, 2, 7, 40])
def test_cells_miss_no_match(rows, count):
    data = points(200, 9)
    pivots = dedup.Pivots([p for _, p in data[:count]] + [data[0][1]])
    found = dedup.cells(rows("id int, embedding array<float>", data), pivots, 0.18**0.5).collect()
    homes = {r["id"]: (r["top"], r["cell"]) for r in found if r["home"]}
    reached = {(r["id"], r["top"], r["cell"]) for r in found}
    assert len(homes) == len(data)
    assert all((i, *homes[j]) in reached for i, a in data for j, b in data if near(a, b))


# --- approximate options ------------------------------------------------------------------

def test_rows_of_a_min_hash_do_not_all_meet(rows, monkeypatch):
    """A word of all texts is the min-hash of many; rows meet by words that few have."""
    from newsloom.operators import approximate

    seen, keep_first = [], dedup.keep_first

    def spy(ids, keys, *args, **kwargs):
        seen.append(keys.groupBy("key").count().agg(F.max("count")).first()[0])
        return keep_first(ids, keys, *args, **kwargs)

    monkeypatch.setattr(approximate.dedup, "keep_first", spy)
    texts = [(i, "everywhere " + " ".join(f"rare{i}word{j}" for j in range(6))) for i in range(150)]
    texts += [(1000 + i, texts[i][1]) for i in range(3)] + [(2000 + i, texts[i][1] + " " + " ".join(f"rare{i}word{j}" for j in range(3))) for i in range(3)]
    long = " ".join(f"shared{j}word" for j in range(30))
    texts += [(3000, long), (3001, long + " another"), (3003, "")]
    got = approximate.lexical_dedup_lsh(rows("news_id int, full_text string", texts), ord_col="news_id")
    assert {r["news_id"] for r in got.filter("kept").collect()} == {*range(150), 3000, 3003}
    assert seen and (seen[0] or 0) <= 2


def test_lsh_options_find_most(rows):
    data = points(400, 12)
    exact = greedy(data, near)
    got = {r["news_id"] for r in approximate.vector_dedup_lsh(rows("news_id int, embedding array<float>", data), ord_col="news_id").filter("kept").collect()}
    assert len(set(range(400)) - got) >= 0.9 * (400 - len(exact))
    texts = word_sets(200, 8)
    exact = greedy(texts, alike)
    got = {r["news_id"] for r in approximate.lexical_dedup_lsh(rows("news_id int, full_text string", texts), ord_col="news_id").filter("kept").collect()}
    assert 200 - len(got) >= 0.9 * (200 - len(exact)) and {i for i, t in texts if t == "a b c"} <= got
    none = rows("news_id int, full_text string, embedding array<float>", [])
    assert approximate.lexical_dedup_lsh(none, ord_col="news_id").collect() == approximate.vector_dedup_lsh(none, ord_col="news_id").collect() == []


# --- ids ------------------------------------------------------------------------------------

def test_few_ids_are_pushed_down(spark, rows, tmp_path):
    store = tables.Store(spark, f"{tmp_path}/db", 4).create()
    for batch in range(3):
        store.add_keys(spark.range(batch * 50_000, batch * 50_000 + 50_000).select(F.sha1(F.col("id").cast("string")).alias("news_id")), f"b{batch}")
    one = spark.range(70_000, 70_001).select(F.sha1(F.col("id").cast("string")).alias("news_id"))
    found = store.known_keys(one, "x")
    plan = plan_of(found)
    assert "PushedFilters: [In(news_id" in plan or "PushedFilters: [EqualTo(news_id" in plan.replace("IsNotNull(news_id), ", "")
    assert found.count() == 1
    # Files whose filter cannot hold the id are not decoded: one bucket of one batch is.
    scans = found._jdf.queryExecution().executedPlan()
    assert int(found.select("news_id", F.input_file_name().alias("f")).select("f").distinct().count()) == 1, scans
    many = spark.range(0, 200_000).select(F.sha1(F.col("id").cast("string")).alias("news_id"))
    assert store.known_keys(many, "x").count() == 150_000 and store.known_keys(many, "b1").count() == 100_000
    assert store.known_keys(many.limit(0), "x").count() == 0


# --- expiring state ------------------------------------------------------------------------------

def test_an_id_is_forgotten_after_its_life(spark, rows, tmp_path):
    schema = "news_id string, priority string, suggestion string, signal_score double"
    life, seen = 12, []

    def go(ids):
        rows(schema, [(i, "HIGH", "BUY", 90.0) for i in ids]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = refresh.announce_while(stream, F.concat(F.lit("buy "), "news_id"), life)
        refresh.to_files(out, f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
        got = sorted(r["message"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
        new = [m for m in got if got.count(m) > seen.count(m)]
        seen[:] = got
        return sorted(set(new))

    begin = time.time()
    assert go(["a", "b", "a"]) == ["buy a", "buy b"]
    first = time.time()
    if first - begin < life - 4:                       # a repeat within the life is silent
        assert go(["a", "c"]) == ["buy c"]
    time.sleep(max(0, life + 2 - (time.time() - first)))
    assert go(["a"]) == ["buy a"]


# --- cleaning ------------------------------------------------------------------------------------------

def test_each_field_is_cleaned_once(rows):
    entries = rows("source string, pos int, link string, id string, title string, summary string, published string, updated string",
                   [("S", 1, "a", "", "x &amp; y", "<b>z</b> &lt;i&gt;", "", "")])
    items = ingest.news_items(entries, F.lit("f"), None)
    optimized = items._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("<script") == 3              # title, summary, and both together
    row = items.head()
    assert (row["headline"], row["full_text"]) == ("x & y", "x & y z")


def test_references_without_an_end(values):
    texts = ["&ampx &notit; &notin; &copy2 &unknown; &AMP;&am; &ltgt &sup1a &frac12x", "a&#0;b", None]
    assert values(tx.decode_entities(F.col("x")), texts) == ["&x ¬it; ∉ ©2 &unknown; &&am; <gt ¹a ½x", "a�b", None]


def test_vectors_that_reach_most_cells_are_compared_in_blocks(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(dedup, "REACH", 2)
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(dedup, "_keep_by_cells", None)
    rng = np.random.default_rng(8)
    given = [[float(x) for x in v] for v in rng.normal(size=(80, 6))]
    store = tables.Store(spark, f"{tmp_path}/db").create("embeddings", "vector_pivots", "vector_cells")
    got = {}
    for name, part in (("b0", range(50)), ("b1", range(50, 80))):
        table = rows("news_id int, embedding array<float>", [(i, given[i]) for i in part])
        flags, _ = vectors.semantic_run(store, table, name, ord_col="news_id", threshold=4.0, cell_rows=4)
        got |= {r["news_id"]: r["kept"] for r in flags.collect()}
    kept = []
    for v in given:
        if not any(((np.float32(v) - np.float32(k)) ** 2).sum() < 4.0 for k in kept):
            kept.append(v)
    assert [got[i] for i in range(80)] == [v in kept for v in given]


def test_an_order_tells_its_size(spark, rows, tmp_path):
    """Stores made before the order had a size go on with theirs."""
    store = tables.Store(spark, f"{tmp_path}/db", 2).create("word_order")
    prints = rows("id string, fp array<string>", [("a", ["word", "other"]), ("b", ["word"])])
    made = known.word_order(store, prints, "b0")
    assert len(made) == dedup.CELLS > known.OLD_CELLS and sorted(made[made > 0]) == [1, 4]
    assert (known.word_order(store, prints.limit(0), "b1") == made).all()
    old = tables.Store(spark, f"{tmp_path}/old", 2).create("word_order")
    old.write("word_order", rows("cell int, step int", [(i, i % 5) for i in range(known.OLD_CELLS)]), "b0")
    assert (known.word_order(old, prints, "b1") == np.arange(known.OLD_CELLS) % 5).all()


def test_an_anchor_leaves_few_texts_to_verify(spark, rows):
    """Texts share any five bytes of the keyword with it, but not seven."""
    words = rows("keyword string", [("abcdefghi",), ("abc",)])
    texts = rows("text string", [("abcdef cdefgh efghi",)] * 3 + [("abcdefghi",)])
    counts = keywords.gram_counts(texts)
    grams = {r["keyword"]: r["gram"] for r in words.mapInArrow(keywords._anchor(counts), "keyword string, gram long").collect()}
    met = [{g for _, g in zip(*(x.tolist() for x in keywords.grams(pa.array([t]), 7)))} for t in ("abcdef cdefgh efghi", "abcdefghi")]
    assert [grams["abcdefghi"] in m for m in met] == [False, True]
    assert grams["abc"] == int.from_bytes(b"\x03abc")


def test_keywords_are_found_by_place(rows):
    """As a search finds them, in texts that hold the first bytes of a keyword many times."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé"[:1 + i % 3]) for _ in range(20 * i)) for i in range(8)]
    asked = [(i, w) for i, t in enumerate(texts) for w in
             [t[j:j + 9] for j in range(0, len(t), 7)] + ["".join(rng.choice("ab") for _ in range(10)) for _ in range(9)] + ["a" * 40]
             if len(w.encode()) > keywords.GRAM]
    got = keywords._stands(pa.array(texts), np.array([i for i, _ in asked]), pa.array([w for _, w in asked]))
    assert got.tolist() == [w in texts[i] for i, w in asked] and 10 < got.sum() < len(asked)


def test_upserts_evaluate_the_signals_once(spark, rows, monkeypatch):
    from newsloom.plans import queries

    signals = rows("doc_id bigint, news_id string, suggestion string, confidence double", [(i, f"n{i}", "BUY", 0.7) for i in range(4)])
    labels = rows("doc_id bigint, quality int, toxic int", [(0, 1, 0), (1, 0, 1)])
    monkeypatch.setattr(queries, "rule_signals", lambda *args: signals)
    monkeypatch.setattr(queries.samples, "stored_docs", lambda *args: labels)
    for name in ("upsert_ignore", "upsert_last"):
        got = queries.QUERIES[name](spark, "")
        assert "ExistingRDD" not in plan_of(got) and "LocalTableScan" not in plan_of(got)
        assert sorted(r["news_id"] for r in got.collect()) == ["n0", "n1", "n2", "n3"]


def test_only_near_matches_of_stored_rows_bring_their_word_sets(spark, rows, tmp_path, monkeypatch):
    """Large sets fill a short signature, so those that share rare words are only told apart by a wide one."""
    rng = random.Random(17)
    texts = [" ".join(f"w{i:06d}" for i in {*rng.sample(range(100), 30), *rng.sample(range(1000, 4000), 1900)}) for _ in range(24)]
    texts.append(texts[3] + " another")
    store = tables.Store(spark, f"{tmp_path}/db", 4).create()
    schema = "news_id int, full_text string"
    known.lexical_run(store, rows(schema, list(enumerate(texts))[:12]), "b0", ord_col="news_id")
    exact = tx.jaccard_at_least

    def noted(a, b, percent):
        tell = F.udf(lambda n: not open(f"{tmp_path}/verified", "a").write("x\n") or True, "boolean").asNondeterministic()
        return tell(F.size(a)) & exact(a, b, percent)

    monkeypatch.setattr(tx, "jaccard_at_least", noted)
    late = rows(schema, list(enumerate(texts))[12:])
    prints = dedup.fingerprints(late, "news_id", "full_text", "news_id").select(F.col("id").cast("string"), "fp")
    keys = known.keys_of(prints, known.word_order(store, prints, "b1"), 82)
    pairs = keys.alias("a").join(known.postings_of(store, keys, "b1").alias("b"), (F.col("a.word") == F.col("b.word")) & dedup.may_overlap(82))
    met = pairs.select("a.id", "b.news_id").distinct().count()
    found = known.matching(store, prints, "b1")
    assert [r["id"] for r in found.collect()] == ["24"]
    with open(f"{tmp_path}/verified") as f:
        assert len(f.readlines()) <= 2 < 50 < met


def test_a_cut_leaves_no_shuffle_files(spark):
    def left():
        local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in local for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}

    before, setting = left(), spark.conf.get(session.CLEAN_UP)
    table = session.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if left() <= before:
            break
        time.sleep(0.1)
    assert left() <= before and table.count() == 7 and spark.conf.get(session.CLEAN_UP) == setting
