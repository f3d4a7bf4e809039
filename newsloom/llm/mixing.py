"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies of each of its
documents: whole copies plus a fraction. Fractions are rounded in pairs: mass
(fraction times size) moves at random from one document of the pair to the
other until one of them is whole, which keeps the source's mass exactly and
each document's expectation. Documents meet in blocks of about ``BLOCK_ROWS``;
each block leaves one fractional document, those meet in blocks again, and so
on up a tree until one per source is left, which is rounded to the nearer side.
A source therefore misses its target by half of one document at most.

All arithmetic is on whole units of mass, and randomness is a hash of seed and
documents, so reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import cut

BLOCK_ROWS = 64
CAP = 3
WEIGHTS = (1, 2, 3)
SEED = 5
UNITS = 1 << 20          # units of mass per word
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """``source, source_size, weight`` to ``target``: shares of all sizes by weight, none above
    ``cap`` times its source; the excess goes to the others by weight.

    Solved in one pass: sources fill up in the order of size over weight, so
    sums over those before tell from where on nobody is full. A window over all
    sources; the number of sources is far below that of documents.
    """
    ratio = F.col("source_size") / F.col("weight")
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = sizes.withColumns({
        "__llm_full": F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)),
        "__llm_done": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "__llm_all": F.sum("source_size").over(every),
        "__llm_weights": F.sum("weight").over(every),
    })
    level = (F.col("__llm_all") - F.col("__llm_full")) / (F.col("__llm_weights") - F.col("__llm_done"))
    open_ = F.col("source_size") * cap > level * F.col("weight")
    rows = rows.withColumns({"__llm_level": level, "__llm_open": open_})
    # The level rises while sources are full and falls behind the first open one.
    rows = rows.withColumn("__llm_final", F.max(F.when(F.col("__llm_open"), F.col("__llm_level"))).over(every))
    share = F.least(F.col("__llm_final") * F.col("weight"), (F.col("source_size") * cap).cast("double"))
    return rows.select("source", "source_size", "weight",
                       F.when(F.col("__llm_final").isNull(), (F.col("source_size") * cap).cast("double"))
                       .otherwise(share).alias("target"))


def weigh(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Repeat ``weights`` along the sources, by code point with null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    slot = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    options = F.array(*[F.lit(int(w)) for w in weights])
    return sizes.withColumn("weight", F.get(options, slot))


def _unit(*parts) -> Column:
    """A number in [0, 1) that follows from the seed and the documents."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _pivot(acc: Column, x: Column, level: int, seed: int) -> Column:
    """One meeting: the fraction that stays open, and what got settled behind it."""
    a, b = acc["open"], x
    up = F.least(a["full"] - a["mass"], b["mass"])        # from b to a
    down = F.least(a["mass"], b["full"] - b["mass"])      # from a to b
    to_a = _unit(F.lit(seed), F.lit(level), a["row"], b["row"]) * (up + down) < down
    moved = F.when(to_a, up).otherwise(-down)

    def with_mass(unit: Column, mass: Column) -> Column:
        return F.struct(unit["row"].alias("row"), unit["full"].alias("full"), mass.alias("mass"))

    new_a, new_b = with_mass(a, a["mass"] + moved), with_mass(b, b["mass"] - moved)
    whole_a = (new_a["mass"] == 0) | (new_a["mass"] == new_a["full"])
    settled = F.when(whole_a, new_a).otherwise(new_b)
    still = F.when(whole_a, new_b).otherwise(new_a)
    return F.struct(still.alias("open"), F.array_append(acc["settled"], settled).alias("settled"))


def _round_level(units: DataFrame, blocks: Column, level: int, seed: int) -> DataFrame:
    """Round inside blocks; gives all units with their new mass and ``open`` for the one left over."""
    grouped = units.groupBy("source", blocks.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "row").alias("at"), "row", "full", "mass"))).alias("units"))
    plain = F.transform("units", lambda u: F.struct(u["row"].alias("row"), u["full"].alias("full"), u["mass"].alias("mass")))
    grouped = grouped.withColumn("units", plain)
    start = F.struct(F.col("units")[0].alias("open"), F.slice("units", 1, 0).alias("settled"))
    done = grouped.select("source", F.aggregate(
        F.slice("units", 2, 1 << 30), start, lambda acc, x: _pivot(acc, x, level, seed)).alias("r"))
    all_units = F.concat(F.transform("r.settled", lambda u: F.struct(u.alias("u"), F.lit(False).alias("open"))),
                         F.array(F.struct(F.col("r.open").alias("u"), F.lit(True).alias("open"))))
    return done.select("source", F.inline(all_units)).select(
        "source", "u.row", "u.full", "u.mass",
        (F.col("open") & (F.col("u.mass") > 0) & (F.col("u.mass") < F.col("u.full"))).alias("open"))


def _rounded(units: DataFrame, seed: int, block_rows: int) -> DataFrame:
    """``source, row, full, mass`` with 0 < mass < full to rows with ``extra`` 0 or 1."""
    most = units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    settled, level, rest = [], 0, units
    while True:
        blocks = most // block_rows + 1
        block = F.pmod(F.xxhash64(F.lit(seed + 17 + level), "row"), F.lit(blocks))
        done = cut(_round_level(rest, block, level, seed))
        settled.append(done.filter(~F.col("open")))
        rest = done.filter("open").drop("open")
        level += 1
        if blocks == 1:
            settled.append(rest)
            break
        most = min(blocks, most // 2)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), settled)
    return rows.select("row", (F.col("mass") * 2 >= F.col("full")).cast("long").alias("extra"))


def plan(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
         weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED,
         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """How often the mix takes each document: ``doc_id, source, size, source_size, target, copies, taken``.

    A document's size is its number of words; null or empty texts have none and
    take no part (0 copies). Null is a source of its own, last in order.
    Repeated rows with one key and size are one unit each, told apart by a
    number. An empty table gives no rows. Columns that are not named are ignored.
    """
    rows = documents.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
                            n_words(F.col(f"`{text}`")).alias("size"))
    numbered = Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(1))
    rows = cut(rows.withColumn("repeat", F.row_number().over(numbered))
               .withColumn("row", F.struct("doc_id", "repeat", F.xxhash64("source", "size").alias("tie"))))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = cut(targets(weigh(sizes, weights), cap))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    open_ = (
        rows.filter("size > 0").join(goal.withColumnRenamed("source", "__llm_s"), F.col("source").eqNullSafe(F.col("__llm_s")))
        .withColumn("__llm_part", share - F.floor(share))
        .select("source", "row", (F.col("size") * UNITS).alias("full"),
                F.floor(F.col("__llm_part") * F.col("size") * UNITS).cast("long").alias("mass"))
        .filter("mass > 0 and mass < full")
    )
    extra = _rounded(open_, seed, block_rows)
    whole = F.when(F.col("size") > 0, F.floor(share)).otherwise(0).cast("long")
    return (
        rows.join(goal.withColumnRenamed("source", "__llm_s"), F.col("source").eqNullSafe(F.col("__llm_s")))
        .join(extra, "row", "left")
        .withColumn("copies", whole + F.coalesce("extra", F.lit(0)))
        .select("doc_id", "source", "size", "source_size", "target", "copies",
                (F.col("copies") * F.col("size")).alias("taken"))
    )


def apply(documents: DataFrame, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``documents`` as often as the plan takes it."""
    copies = plan(documents, key, source, **options).groupBy("doc_id", "source", "size").agg(
        F.count("*").alias("__llm_rows"), F.sum("copies").alias("__llm_total"))
    size = n_words(F.col("`%s`" % options.get("text", "text")))
    same = (F.col(f"`{key}`").eqNullSafe(F.col("__llm_doc")) & F.col(f"`{source}`").cast("string").eqNullSafe(F.col("__llm_source"))
            & (size == F.col("__llm_size")))
    joined = documents.join(copies.select(F.col("doc_id").alias("__llm_doc"), F.col("source").alias("__llm_source"),
                                          F.col("size").alias("__llm_size"), "__llm_rows", "__llm_total"), same)
    # Repeated rows share their copies out: the first ones take one more.
    one = Window.partitionBy("__llm_doc", "__llm_source", "__llm_size").orderBy(F.lit(1))
    number = F.when(F.col("__llm_rows") == 1, F.lit(1)).otherwise(F.row_number().over(one))
    n = F.floor(F.col("__llm_total") / F.col("__llm_rows")) + (number <= F.col("__llm_total") % F.col("__llm_rows")).cast("long")
    return (joined.withColumn("__llm_n", n).filter("__llm_n > 0")
            .withColumn("__llm_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__llm_n"))))
            .select(*[F.col(f"`{c}`") for c in documents.columns]))
