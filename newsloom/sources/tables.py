"""Keyed tables on plain Parquet.

Every write of a run goes to the run's own folder (``batch_id``), inside it by
further columns. A repeated run replaces the whole folder, whatever days or
buckets its rows name now, so it adds nothing twice and leaves nothing behind;
no write ever rewrites the rows of other runs. ``compact`` joins the folders of
finished runs into one.

table          inside a batch by   because
news_raw       day                 feeds read the newest days
signals        day                 same day as its news
news_keys      id_bucket           a run looks its ids up in their buckets only
fingerprints   id_bucket           word sets are fetched by id
postings       bucket              a run looks its words up in their buckets only
vector_cells   top (and gen)       a run looks its vectors up around their pivots only
alert_log      channel             looked up per channel
outbox         channel             what hooks were handed, per channel
source_health  (by source, no batch)  one partition is one key: writing is the upsert
others         -
"""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from newsloom import schemas
from newsloom.functions import values as vl
from newsloom.session import cut, release

ID_BUCKETS = 64
FEW_IDS = 1000          # ids of a run that are looked up one by one

# Columns of a signal that keep the stored value when there is one.
FIRST_KEPT = ("price_at_signal",)


# --- row sets ------------------------------------------------------------------

def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of ``new`` to append: first per key, keys not stored yet."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    first = new.withColumn("_n", F.row_number().over(rank)).filter("_n = 1").drop("_n")
    return first.join(stored.select(*keys), keys, "left_anti")


def upsert_last(
    stored: DataFrame, new: DataFrame, keys: list[str], order: list[Column]
) -> DataFrame:
    """All rows after the write: the last of ``new`` replaces what is stored."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    last = new.withColumn("_n", F.row_number().over(rank)).filter("_n = 1").drop("_n")
    return stored.join(last.select(*keys), keys, "left_anti").unionByName(
        last, allowMissingColumns=True
    )


def upsert_signals(
    stored: DataFrame, new: DataFrame, first_kept: tuple[str, ...] = FIRST_KEPT
) -> DataFrame:
    """All signals after the write: new values win, but the first price stays.

    ``new`` has one row per id. Both sides are matched in one full outer join.
    """
    s, n = stored.alias("s"), new.alias("n")
    known = F.col("n.news_id").isNotNull()

    def value(name: str) -> Column:
        old, fresh = F.col(f"s.{name}"), F.col(f"n.{name}")
        if name in first_kept:
            return F.coalesce(old, fresh)
        return F.when(known, fresh).otherwise(old)

    columns = [c for c in stored.columns if c != "news_id"]
    return s.join(n, F.col("s.news_id") == F.col("n.news_id"), "full_outer").select(
        F.coalesce("s.news_id", "n.news_id").alias("news_id"),
        *[value(c).alias(c) for c in columns],
    )


def with_news(signals: DataFrame, news: DataFrame) -> DataFrame:
    """Signals whose news row exists; deleting news deletes its signal."""
    return signals.join(news.select("news_id"), "news_id", "left_semi")


def evolve(rows: DataFrame, schema: StructType) -> DataFrame:
    """Add the columns of ``schema`` that are missing, as nulls."""
    empty = rows.sparkSession.createDataFrame([], schema)
    return rows.unionByName(empty, allowMissingColumns=True)


# --- the store -----------------------------------------------------------------

def _plus(schema: StructType, ddl: str) -> StructType:
    return StructType([*schema.fields, *schemas.struct(ddl).fields])


class Store:
    """The tables of one deployment under ``root``."""

    TABLES: dict[str, tuple[StructType, tuple[str, ...]]] = {
        "items": (
            _plus(schemas.NEWS, "feed_no int, pos string, batch_id string"), ("batch_id",)
        ),
        "news_raw": (_plus(schemas.NEWS, "day date, batch_id string"), ("batch_id", "day")),
        "signals": (_plus(schemas.SIGNALS, "day date, batch_id string"), ("batch_id", "day")),
        "news_keys": (
            schemas.struct("news_id string, id_bucket int, batch_id string"),
            ("batch_id", "id_bucket"),
        ),
        "fingerprints": (_plus(schemas.FINGERPRINTS, "id_bucket int, batch_id string"), ("batch_id", "id_bucket")),
        "postings": (
            schemas.struct("word string, p int, n int, s0 bigint, s1 bigint, s2 bigint, s3 bigint, news_id string, bucket int, batch_id string"),
            ("batch_id", "bucket"),
        ),
        "word_order": (schemas.struct("cell int, step int, batch_id string"), ("batch_id",)),
        "embeddings": (_plus(schemas.EMBEDDINGS, "batch_id string"), ("batch_id",)),
        "vector_pivots": (schemas.struct("place int, rows bigint, vector array<float>, gen int"), ("gen",)),
        "vector_cells": (
            schemas.struct("news_id string, embedding array<float>, cell int, gen int, batch_id string, top int"),
            ("gen", "batch_id", "top"),
        ),
        "alert_log": (
            StructType(
                [f for f in schemas.ALERTS.fields if f.name != "channel"]
                + [StructField("channel", StringType()), StructField("batch_id", StringType())]
            ),
            ("batch_id", "channel"),
        ),
        "outbox": (
            schemas.struct("news_id string, claimed_at timestamp, channel string, batch_id string"),
            ("batch_id", "channel"),
        ),
        "compacted": (schemas.struct("old string, batch_id string"), ("batch_id",)),
        "source_health": (
            StructType(
                [f for f in schemas.HEALTH.fields if f.name != "source"]
                + [StructField("source", StringType())]
            ),
            ("source",),
        ),
        "batches": (schemas.struct("as_of timestamp, batch_id string"), ("batch_id",)),
        "errors": (_plus(schemas.ERRORS, "batch_id string"), ("batch_id",)),
        "run_log": (_plus(schemas.RUN_LOG, "batch_id string"), ("batch_id",)),
    }

    def __init__(self, spark: SparkSession, root: str, id_buckets: int = ID_BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.id_buckets = id_buckets

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, *names: str) -> Store:
        """Create missing tables (all, or the named ones), empty."""
        for name in names or self.TABLES:
            if not self._exists(name):
                self._empty(name)
        return self

    def reset(self) -> None:
        """Empty all tables and keep their schemas."""
        for name in self.TABLES:
            self._empty(name)

    def _exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return path.getFileSystem(conf).exists(path)

    def _empty(self, name: str) -> None:
        schema, parts = self.TABLES[name]
        (
            self.spark.createDataFrame([], schema).write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy(*parts).parquet(self.path(name))
        )

    def read(self, name: str, batch_id: str | None = None, before: str | None = None) -> DataFrame:
        """A table, one run's part of it, or all but one run's part. Columns
        added later read as null in old files."""
        schema, _ = self.TABLES[name]
        rows = self.spark.read.schema(schema).parquet(self.path(name))
        if batch_id is not None:
            rows = rows.filter(F.col("batch_id") == batch_id)
        if before is not None:
            rows = rows.filter(F.col("batch_id") != before)
        return rows

    def _folder(self, name: str, batch_id: str) -> str:
        return f"{self.path(name)}/batch_id={quote(batch_id, safe='')}"

    def write(self, name: str, rows: DataFrame, batch_id: str | None = None, **totals: Column) -> dict[str, int]:
        """Write rows: with ``batch_id`` as all the run has in this table, else by
        replacing the partitions that the rows name.

        Rows are rebalanced by day or bucket, so that a partition gets few files,
        yet one that holds most rows is split over tasks. ``totals`` are
        aggregates of the rows, observed while they are written and returned.
        """
        watch = Observation()
        if totals:
            rows = rows.observe(watch, *[c.alias(k) for k, c in totals.items()])
        schema, parts = self.TABLES[name]
        inner = [p for p in parts if p != "batch_id"]
        fields = [f for f in schema.fields if batch_id is None or f.name != "batch_id"]
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in fields])
        if inner:
            rows = rows.hint("rebalance", *inner)
        if batch_id is None:
            writer, path = rows.write.partitionBy(*parts).option("partitionOverwriteMode", "dynamic"), self.path(name)
        else:
            writer, path = rows.write.option("partitionOverwriteMode", "static"), self._folder(name, batch_id)
            writer = writer.partitionBy(*inner) if inner else writer
        writer.mode("overwrite").parquet(path)
        return self._observed(watch, path, totals) if totals else {}

    def _observed(self, watch: Observation, path: str, totals: dict[str, Column]) -> dict[str, int]:
        try:
            return {k: v or 0 for k, v in watch.get.items()}
        except Py4JJavaError:
            # Rows that the optimizer finds to be none are not observed.
            if self.spark.read.schema("news_id string").parquet(path).head() is not None:
                raise
            return dict.fromkeys(totals, 0)

    # --- one run at a time ---

    def acquire(self, owner: str, stale_seconds: float | None = None) -> bool:
        """Take the store for ``owner``; false while somebody else has it.

        The marker is a file that is only created if it does not exist, which
        the file system must do atomically (HDFS and local disks do). It is
        taken over by the same owner, as a repeat after a crash is, and when it
        is older than ``stale_seconds``.
        """
        fs, hadoop = self._fs("")
        path = hadoop.Path(f"{self.root}/_running")
        try:
            out = fs.create(path, False)
            out.write(bytearray(owner.encode()))
            out.close()
            return True
        except Py4JJavaError:
            if not fs.exists(path):
                raise
        holder = self.holder()
        if holder == owner:
            return True
        if stale_seconds is None or holder is None:
            return False
        age = time.time() - fs.getFileStatus(path).getModificationTime() / 1000
        if age > stale_seconds:
            self.free(holder)
            return self.acquire(owner)
        return False

    def holder(self) -> str | None:
        """Who has the store."""
        fs, hadoop = self._fs("")
        path = hadoop.Path(f"{self.root}/_running")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def free(self, owner: str) -> None:
        """Give the store back; without effect if ``owner`` does not have it."""
        if self.holder() == owner:
            fs, hadoop = self._fs("")
            fs.delete(hadoop.Path(f"{self.root}/_running"), False)

    def pin_time(self, batch_id: str, as_of: Column) -> str:
        """The run's time, fixed when the batch is first seen and used again by its repeats."""
        stored = self.read("batches", batch_id).select(F.col("as_of").cast("string")).head()
        if stored is None:
            self.write("batches", self.spark.range(1).select(as_of.alias("as_of")), batch_id)
            stored = self.read("batches", batch_id).select(F.col("as_of").cast("string")).head()
        return stored[0]

    #: Tables whose rows belong to a batch; ``compact`` joins all of them.
    OF_BATCHES = ("items", "news_raw", "signals", "news_keys", "fingerprints", "postings", "word_order", "embeddings", "alert_log", "outbox", "batches", "errors", "run_log")

    def compact(self, batch_ids: list[str], into: str) -> None:
        """Join the folders of finished batches into one batch ``into``, in all tables.

        What was joined is noted first, and a joined batch is refused from then
        on: its rows could not be replaced any more. A joined folder is complete,
        under a name that readers skip, before the old ones go; a compaction
        that broke off is finished by repeating it with the same names.
        """
        batch_ids = [b for b in batch_ids if b != into]
        self.write("compacted", self.spark.createDataFrame([(b,) for b in batch_ids], "old string"), into)
        for name in self.OF_BATCHES:
            self._compact(name, batch_ids, into)

    def _compact(self, name: str, batch_ids: list[str], into: str) -> None:
        fs, hadoop = self._fs(name)
        ready = hadoop.Path(f"{self.path(name)}/_compact-{quote(into, safe='')}")
        done = hadoop.Path(self._folder(name, into))
        marker = hadoop.Path(ready, "_SUCCESS")
        if fs.exists(done) and not fs.exists(ready):
            return
        if not fs.exists(marker):
            _, parts = self.TABLES[name]
            inner = [p for p in parts if p != "batch_id"]
            rows = self.read(name).filter(F.col("batch_id").isin(batch_ids)).drop("batch_id")
            rows = rows.hint("rebalance", *inner) if inner else rows
            writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
            (writer.partitionBy(*inner) if inner else writer).parquet(ready.toString())
        for batch_id in batch_ids:
            fs.delete(hadoop.Path(self._folder(name, batch_id)), True)
        fs.rename(ready, done)

    def is_compacted(self, batch_id: str) -> bool:
        return self.read("compacted").filter(F.col("old") == batch_id).head() is not None

    def _fs(self, name: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        return hadoop.Path(self.path(name)).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def bucket_of(self, news_id: Column) -> Column:
        return F.pmod(F.xxhash64(news_id), F.lit(self.id_buckets)).cast("int")

    def add_keys(self, ids: DataFrame, batch_id: str) -> None:
        """Note the ids of a run: sorted, and with a Bloom filter per row group, so that a look-up skips what cannot hold an id."""
        rows = ids.select("news_id", self.bucket_of(F.col("news_id")).alias("id_bucket"))
        rows.hint("rebalance", "id_bucket").sortWithinPartitions("id_bucket", "news_id").write.mode("overwrite").option(
            "partitionOverwriteMode", "static").option("parquet.bloom.filter.enabled#news_id", "true").option(
            "parquet.bloom.filter.adaptive.enabled", "true").partitionBy("id_bucket").parquet(
            self._folder("news_keys", batch_id))

    def known_keys(self, ids: DataFrame, batch_id: str) -> DataFrame:
        """Stored ids that could equal one of ``ids``.

        Few ids are pushed down to the files, where sorting and Bloom filters
        skip nearly all row groups. Of many, only the buckets are pushed, of
        which there are at most ``id_buckets``.
        """
        stored = self.read("news_keys", before=batch_id)
        few = [r["news_id"] for r in ids.select("news_id").distinct().limit(FEW_IDS + 1).collect()]
        if len(few) <= FEW_IDS:
            named = self.spark.createDataFrame([(i,) for i in few], "news_id string")
            touched = named.select(self.bucket_of(F.col("news_id")).alias("b")).distinct().collect()
            stored = stored.filter(F.col("news_id").isin(few))
        else:
            touched = ids.select(self.bucket_of(F.col("news_id")).alias("b")).distinct().collect()
        return stored.filter(F.col("id_bucket").isin([r["b"] for r in touched]))

    def merge_signals(self, new: DataFrame, batch_id: str) -> None:
        """Write signals again. Stored rows are found by ``news_id``, wherever they lie; a known
        signal stays on its day and in the run that first wrote it. Only
        partitions with such signals are rewritten. ``new`` has ``day``."""
        new = cut(new.withColumn("batch_id", F.lit(batch_id)))
        stored = self.read("signals")
        places = stored.join(new.select("news_id"), "news_id", "left_semi").select("batch_id", "day").distinct()
        same = stored["batch_id"].eqNullSafe(places["batch_id"]) & stored["day"].eqNullSafe(places["day"])
        touched = stored.join(places, same, "left_semi")
        merged = cut(upsert_signals(touched, new, (*FIRST_KEPT, "day", "batch_id")))
        self.write("signals", merged)
        release(new, merged)

    def delete_news(self, ids: DataFrame) -> None:
        """Delete news rows; their signals go with them. Only partitions that hold such rows are rewritten."""
        gone = cut(ids.select("news_id").distinct())
        for name in ("news_raw", "signals"):
            rows = self.read(name)
            places = cut(rows.join(gone, "news_id", "left_semi").select("batch_id", "day").distinct())
            same = rows["batch_id"].eqNullSafe(places["batch_id"]) & rows["day"].eqNullSafe(places["day"])
            left = cut(rows.join(places, same, "left_semi").join(gone, "news_id", "left_anti"))
            kept = left.select("batch_id", "day").distinct()
            fs, hadoop = self._fs(name)
            empty = places.join(kept, places["batch_id"].eqNullSafe(kept["batch_id"]) & places["day"].eqNullSafe(kept["day"]), "left_anti")
            self.write(name, left)
            for row in empty.collect():          # one row per emptied partition of the deleted news
                day = "__HIVE_DEFAULT_PARTITION__" if row["day"] is None else row["day"].isoformat()
                fs.delete(hadoop.Path(f"{self._folder(name, row['batch_id'])}/day={day}"), True)
            release(places, left)
        release(gone)

    def log_manual(self, row: DataFrame, news_id: str) -> None:
        """Record a manual notification; a later one for the same news replaces
        it, as both go to the same partition."""
        self.write("alert_log", row, f"manual-{news_id}")


def news_day(published_at: Column, fetched_at: Column) -> Column:
    return F.to_date(vl.feed_time(published_at, fetched_at))


Deliver = Callable[[DataFrame], DataFrame]
