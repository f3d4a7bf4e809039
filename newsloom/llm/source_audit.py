"""How far the sources of a language differ in their words.

Counts of each language's common terms are columns, one per source. Terms with
equal counts everywhere are one entry with a weight; the entries are ordered by
their counts and cut into blocks. A task takes a block and two tiles of columns,
reorders the entries so that equal counts lie together, run-length encodes each
column, and adds for each pair of columns f times the run length over the
intersected runs. Sums over blocks give the exact value of each pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm import words as wd
from newsloom.session import cut

MIN_DOCUMENTS = 10
TOP = 10
BLOCK = 4096          # entries whose columns one task holds
TILE = 48             # columns of a tile
HELD = 300_000        # counts that a task gathers before it passes them on
SCALE = 1_000_000_000

#: Terms are `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` with A-Z in lower case; all else becomes a blank.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term per language and source, combined within the task."""
    total: dict[tuple, tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (n, docs) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()),
                 pa.array([t.decode() for t in n], pa.string()), pa.array(list(n.values()), pa.int64()),
                 pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
        total.clear()

    for batch in wd.slices(batches):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            found = text.encode().translate(_TERMS).split()
            n, docs = total.setdefault((lang, source), (Counter(), Counter()))
            n.update(found)
            docs.update(set(found))
        if sum(len(n) for n, _ in total.values()) > HELD:
            yield from flush()
    yield from flush()


def counts(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
           min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``lang, source, term, n, total``: counts above 0 of the terms in enough documents of their language."""
    wd.small_batches(documents.sparkSession)
    rows = documents.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
                              for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    each = cut(rows.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).filter(
        F.col("docs") >= min_documents).drop("docs")
    return each.drop("docs").join(kept, ["lang", "term"])


def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 v)) in longs: the division goes on by three digits at a time."""
    whole = total + 2 * v
    rest, out = count + 2, F.lit(0).cast("long")
    div = lambda a, b: F.call_function("div", a, b)
    for _ in range(3):
        out, rest = out * 1000 + div(rest * 1000, whole), F.pmod(rest * 1000, whole)
    return out + 1


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(count: np.ndarray, whole: int) -> np.ndarray:
    rest, out = count + 2, np.zeros(len(count), np.int64)
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return out + 1


def runs(column: np.ndarray) -> np.ndarray:
    """First places of the runs of equal values."""
    return np.flatnonzero(np.append(True, column[1:] != column[:-1]))


def pair_value(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], before: np.ndarray) -> int:
    """Sum of f over two run-length columns (first places, shares); ``before[i]`` is the weight of all entries before ``i``."""
    first = np.union1d(a[0], b[0])
    p = a[1][np.searchsorted(a[0], first, side="right") - 1]
    q = b[1][np.searchsorted(b[0], first, side="right") - 1]
    n = np.diff(before[np.append(first, len(before) - 1)])
    return int(((p - q) * (p - q) // (p + q) * n).sum())


PAIRS = "lang string, a int, b int, value long"


def _pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of columns between two tiles over one block of entries."""
    lang, _, left, right = (k.as_py() for k in key)
    table = pa.Table.from_batches(list(batches))
    entry, column, n, weight, whole = (table[c].to_numpy() for c in ("entry", "column", "n", "weight", "whole"))
    wholes = dict(zip(column[entry < 0].tolist(), whole[entry < 0].tolist()))
    columns = sorted(wholes)
    real = entry >= 0
    names, row = np.unique(entry[real], return_inverse=True)
    values = np.zeros((len(columns), len(names)), np.int64)
    values[np.searchsorted(columns, column[real]), row] = n[real]
    weights = np.zeros(len(names), np.int64)
    weights[row] = weight[real]
    # Entries of the block that stand in none of these columns are one more entry, of zeros.
    values = np.pad(values, ((0, 0), (0, 1)))
    weights = np.append(weights, weight[~real][0] - weights.sum())
    # Columns with few different counts first: their runs stay long.
    kinds = np.array([len(np.unique(v)) for v in values])
    order = np.lexsort([values[i] for i in np.argsort(-kinds, kind="stable")])
    before = np.concatenate(([0], np.cumsum(weights[order])))
    coded = {}
    for i, c in enumerate(columns):
        first = runs(values[i][order])
        coded[c] = first, _shares(values[i][order][first], wholes[c])
    pairs = [(a, b) for a in columns if a // TILE == left for b in columns if b // TILE == right and a < b]
    out = [pair_value(coded[a], coded[b], before) for a, b in pairs]
    yield pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(pairs), pa.string()), pa.array([a for a, _ in pairs], pa.int32()),
         pa.array([b for _, b in pairs], pa.int32()), pa.array(out, pa.int64())], ["lang", "a", "b", "value"])


def pair_values(kept: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """``lang, a, b, value`` for columns ``a < b`` of languages with terms; ``groups`` as in ``audit``."""
    each = kept.join(groups.select("lang", "source", "column"), ["lang", "source"])
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "column", "n")).alias(f"h{seed}") for seed in (1, 2)]
    profile = each.groupBy("lang", "term").agg(F.first("total").alias("total"), *marks)
    entries = cut(profile.groupBy("lang", "total", "h1", "h2").agg(
        F.min("term").alias("term"), F.count("*").alias("weight")))
    blocks = int(entries.count() // block) + 1
    placed = cut(entries.repartitionByRange(blocks, "lang", "total", "h1", "h2").select(
        "lang", "term", "weight", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("entry")))
    filled = each.join(placed, ["lang", "term"]).select(
        "lang", "block", "column", "entry", "n", "weight", F.lit(0).cast("long").alias("whole"))
    none = F.lit(0).cast("long")
    # Columns without any count in a block take part with zeros.
    heads = groups.join(placed.groupBy("lang", "block").agg(F.sum("weight").alias("weight")), "lang").select(
        "lang", "block", "column", F.lit(-1).cast("long").alias("entry"), none.alias("n"), "weight", "whole")
    tiles = groups.groupBy("lang").agg((F.floor(F.max("column") / TILE)).cast("int").alias("tiles"))
    tile = F.floor(F.col("column") / TILE).cast("int")
    dealt = filled.unionByName(heads).join(tiles, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), "tiles"))).select(
        "lang", "block", F.least(tile, "other").alias("left"), F.greatest(tile, "other").alias("right"),
        "column", "entry", "n", "weight", "whole")
    return dealt.groupBy("lang", "block", "left", "right").applyInArrow(_pairs, PAIRS).groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"))


def audit(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          min_documents: int = MIN_DOCUMENTS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: every other source of the language with the divergence from
    it, summed over all kept terms. Part ``term``: the ``top`` terms that a
    source uses more than its language does. Values fall with the rank, equal
    ones go by item. Null texts, languages and sources count as empty strings;
    each row is a document, repeated ones too; an empty table gives no rows; a
    language with one source has no pairs; other columns are ignored. All
    arithmetic is exact.
    """
    kept = cut(counts(documents, text, lang, source, min_documents))
    here = documents.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
                              for c, name in ((lang, "lang"), (source, "source"))]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    vocabulary = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(
        F.count("*").alias("v"), F.sum("total").alias("all"))
    zero = F.lit(0).cast("long")
    groups = cut(here.join(own, ["lang", "source"], "left").join(vocabulary, "lang", "left").select(
        "lang", "source", F.coalesce("size", zero).alias("size"), F.coalesce("v", zero).alias("v"),
        F.coalesce("all", zero).alias("all")).withColumn("whole", F.col("size") + 2 * F.col("v")).withColumn(
        "column", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    half = cut(pair_values(kept, groups, block))
    both = half.unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    one = groups.select("lang", "source", F.col("column").alias("a"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("column").alias("b"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = one.join(other, "lang").filter("a <> b").join(both, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))
    sized = kept.join(groups.select("lang", "source", "size", "v", "all"), ["lang", "source"]).withColumns({
        "p": share(F.col("n"), F.col("size"), F.col("v")), "q": share(F.col("total"), F.col("all"), F.col("v"))})
    terms = sized.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(order)
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))
