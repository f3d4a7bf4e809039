"""Stored index of kept news: finds new rows that match one of them by word overlap.

``postings`` holds the prefix words of every kept row, bucketed by word, with
what the tests before verification need; ``fingerprints`` holds the word sets,
bucketed by id. Words are ordered once and for all by the counts of the first
run (``word_order``), so prefixes of all runs agree. A run reads the buckets
that its own words name, then the word sets of the rows it met there, and
writes one folder per table with its own rows only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import lexicon as lx
from newsloom.operators import dedup
from newsloom.session import cut, release
from newsloom.sources.tables import Store


def bucket_of(store: Store, word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(store.id_buckets)).cast("int")


OLD_CELLS = 16384         # of orders without a row that tells their size
SIZE = -1                 # in that row, instead of a cell; the step is the size's logarithm


def word_order(store: Store, prints: DataFrame, batch_id: str) -> np.ndarray:
    """The frozen order of words: a table of fixed size, made by the first run that has words."""
    def read() -> np.ndarray | None:
        rows = store.read("word_order").select("cell", "step").toArrow()
        cells, steps = rows["cell"].to_numpy(), rows["step"].to_numpy()
        if not len(cells):
            return None
        order = np.zeros(1 << int(steps[cells == SIZE][0]) if (cells == SIZE).any() else OLD_CELLS, np.uint8)
        order[cells[cells != SIZE]] = steps[cells != SIZE]
        return order

    order = read()
    if order is None:
        order = dedup.word_ranks(prints)
        used = np.flatnonzero(order)
        if len(used):
            rows = pa.table({"cell": np.append(used, SIZE).astype(np.int32),
                             "step": np.append(order[used], dedup.CELLS.bit_length() - 1).astype(np.int32)})
            store.write("word_order", store.spark.createDataFrame(rows).coalesce(1), batch_id)
    return order


def keys_of(prints: DataFrame, order: np.ndarray, percent: int) -> DataFrame:
    """``id, n, s0.., p, word``: a row per prefix word of the word sets ``id, fp``."""
    signed = dedup.signed(prints).filter(F.size("fp") > 0)
    return dedup.prefixes(signed, order, percent).select(
        "id", F.size("fp").alias("n"), *[f"s{i}" for i in range(dedup.SIGNATURE)],
        F.posexplode("prefix").alias("p", "_word")).withColumn("word", F.col("_word.w")).drop("_word")


def _values(rows: DataFrame, bucket: Column) -> list[int]:
    """The buckets that ``rows`` name: at most as many as the store has."""
    return [r[0] for r in rows.select(bucket.alias("b")).distinct().collect()]


def postings_of(store: Store, keys: DataFrame, batch_id: str) -> DataFrame:
    """Stored postings of other runs in the buckets of the words of ``keys``."""
    touched = _values(keys, bucket_of(store, F.col("word")))
    return store.read("postings", before=batch_id).filter(F.col("bucket").isin(touched))


def matching(store: Store, prints: DataFrame, batch_id: str, percent: int = lx.JACCARD_PERCENT, keys: DataFrame | None = None) -> DataFrame:
    """``id`` of those word sets (``id, fp``) that a row kept by an earlier run matches; ``keys`` are theirs, if already written."""
    own = [] if keys is not None else [cut(keys_of(prints, word_order(store, prints, batch_id), percent))]
    keys = keys if keys is not None else own[0]
    a, b = keys.alias("a"), postings_of(store, keys, batch_id).alias("b")
    met = a.join(b, (F.col("a.word") == F.col("b.word")) & dedup.may_overlap(percent)).select(
        F.col("a.id").alias("id"), F.col("b.news_id").alias("other")).distinct()
    met = cut(met)
    sets = store.read("fingerprints", before=batch_id).filter(
        F.col("id_bucket").isin(_values(met, store.bucket_of(F.col("other")))))
    confirm, scratch = dedup.confirm_overlap(prints.select("id", "fp"), percent, sets.select(F.col("news_id").alias("id"), "fp"))
    found = cut(confirm(met).select("id").distinct())
    release(*own, met, *scratch)
    return found


def remember(store: Store, prints: DataFrame, batch_id: str, percent: int = lx.JACCARD_PERCENT, keys: DataFrame | None = None) -> int:
    """Store the word sets and postings (``keys``, if already written) of the rows that a run keeps; returns how many."""
    sets = prints.select(F.col("id").alias("news_id"), "fp", store.bucket_of(F.col("id")).alias("id_bucket"))
    n = store.write("fingerprints", sets, batch_id, n=F.count(F.lit(1)))["n"]
    if keys is None:
        keys = keys_of(prints, word_order(store, prints, batch_id), percent)
    store.write("postings", keys.withColumnRenamed("id", "news_id").withColumn("bucket", bucket_of(store, F.col("word"))), batch_id)
    return n


def lexical_run(store: Store, news: DataFrame, batch_id: str, id_col: str = "news_id", text_col: str = "full_text",
                ord_col: str = "ord", percent: int = lx.JACCARD_PERCENT) -> tuple[DataFrame, int]:
    """Flags of ``lexical_dedup`` against all earlier runs of the store and within this one; the kept rows are remembered."""
    prints = cut(dedup.fingerprints(news, id_col, text_col, ord_col))
    named = prints.select(F.col("id").cast("string").alias("id"), "fp")
    keys = cut(keys_of(named, word_order(store, named, batch_id), percent))
    old = matching(store, named, batch_id, percent, keys)
    is_old = prints["id"].cast("string") == old["id"]
    rest = prints.join(old, is_old, "left_anti").withColumn("fixed", F.lit(False))
    decided, scratch = dedup.first_of_sets(rest, percent)
    flags = cut(decided.withColumnRenamed("id", id_col))
    release(*scratch)
    kept = flags.filter("kept").select(F.col(id_col).cast("string").alias("id"))
    n = remember(store, named.join(kept, "id", "left_semi"), batch_id, percent, keys.join(kept, "id", "left_semi"))
    release(keys)
    dropped = prints.join(old, is_old, "left_semi").select(
        F.col("id").alias(id_col), F.size("fp").alias("fp_size"), F.lit(False).alias("exact_copy"), F.lit(False).alias("kept"))
    return flags.unionByName(dropped), n
