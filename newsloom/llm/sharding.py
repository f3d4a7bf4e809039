"""Shards that each hold the sources in the proportions of the whole.

Proportional stratified interleaving: rows are shuffled by a seeded hash and
ranked within their source; a row's fractional rank is its rank over the size
of its source; sorted by fractional rank, any stretch of rows holds each source
in proportion, so cutting the order into equal stretches gives the shards.

Ranks are found without a window over a whole source: hashes and fractional
ranks are uniform, so equal ranges of them are buckets of about
``BUCKET_ROWS`` rows whatever the sources are; counts per bucket give the
offset, a window inside the bucket the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 2_000
SEED = 7
SPAN = 1 << 40


def _ranked(rows: DataFrame, group: list[str], at: Column, order: list, buckets: int,
            rank: str) -> DataFrame:
    """``rank`` (from 0) in ``order`` within ``group``; ``at`` in 0..SPAN-1 rises with the order."""
    rows = rows.withColumn("__llm_bucket", F.floor(at * F.lit(buckets) / F.lit(SPAN)).cast("long"))
    before = Window.partitionBy(*group).orderBy("__llm_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*group, "__llm_bucket").agg(F.count("*").alias("__llm_n")).withColumn(
        "__llm_offset", F.coalesce(F.sum("__llm_n").over(before), F.lit(0)))
    inside = Window.partitionBy(*group, "__llm_bucket").orderBy(*order)
    return (
        rows.withColumn("__llm_inside", F.row_number().over(inside) - 1)
        .join(offsets.drop("__llm_n"), [*group, "__llm_bucket"])
        .withColumn(rank, F.col("__llm_offset") + F.col("__llm_inside"))
        .drop("__llm_bucket", "__llm_inside", "__llm_offset")
    )


def interleave(rows: DataFrame, shards: int, key: str = "doc_id", source: str = "source",
               seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``shard`` (from 0) and ``slot`` (gapless from 0 within the shard); all columns stay.

    Row counts of shards differ by one at most; a source with ``n`` rows has
    between ``n / shards - 1`` and ``n / shards + 1`` rows in each (law
    ``rows``). The result depends on the rows' values alone. Null is a source
    of its own. Rows with equal keys are told apart by their other plain
    columns; rows equal in all of them are interchangeable. An empty table gives
    no rows. Columns of the input named ``shard`` or ``slot`` are replaced.
    """
    rows = rows.drop("shard", "slot")
    plain = [f.name for f in rows.schema.fields
             if f.dataType.typeName() in ("long", "integer", "string", "double", "boolean", "short", "byte", "date", "timestamp")]
    source_of = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("null"))
    keyed = rows.withColumns({
        "__llm_source": source_of,
        "__llm_tie": F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.lit(0),
    }).withColumn("__llm_u", F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{key}`"), "__llm_tie"), F.lit(SPAN)))
    counts = keyed.groupBy("__llm_source").agg(F.count("*").alias("__llm_size"))
    total = keyed.count()
    buckets = total // bucket_rows + 1
    order = ["__llm_u", "__llm_tie"]
    ranked = _ranked(keyed, ["__llm_source"], F.col("__llm_u"), order, buckets, "__llm_rank").join(counts, "__llm_source")
    # A start of its own for each source spreads the single rows of small sources.
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "__llm_source"), F.lit(SPAN)) / F.lit(float(SPAN))
    place = F.least(F.floor((F.col("__llm_rank") + start) / F.col("__llm_size") * SPAN), F.lit(SPAN - 1))
    placed = ranked.withColumn("__llm_place", place.cast("long")).drop("__llm_size", "__llm_rank")
    done = _ranked(placed, [], F.col("__llm_place"), ["__llm_place", "__llm_source", "__llm_u", "__llm_tie"], buckets, "__llm_rank")
    shard = F.floor(F.col("__llm_rank") * shards / F.lit(total))
    first = F.ceil(F.col("shard") * total / F.lit(shards))
    return (
        done.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("__llm_rank") - first).cast("long"))
        .drop("__llm_source", "__llm_tie", "__llm_u", "__llm_place", "__llm_rank")
    )
