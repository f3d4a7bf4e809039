"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results or that every job relies on. All are runtime
# settings, so they also apply to a session somebody else has built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Lists of ids up to this length reach the files as they are (see ``Store.known_keys``).
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
}

# Shuffle files otherwise stay until the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pin(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build(master: str | None = None, app: str = "newsloom", **conf: str) -> SparkSession:
    """Build a session; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Recording the Python line of every column doubles the time to build a plan.
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return pin(builder.getOrCreate())


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The folder named by ``spark.checkpoint.dir`` always wins. Only a local
    session may fall back to a temporary folder: on a cluster that folder
    would die with its machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="newsloom-checkpoint-")
    context.setCheckpointDir(shared)


def _scratch(spark: SparkSession) -> str:
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4()}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written table.

    Unlike a plain checkpoint the table is columnar, and its size is known to
    the planner, which then picks join strategies by real sizes. The shuffle
    files of the write go with its end: nothing else reads them.
    """
    spark = df.sparkSession
    path, before = _scratch(spark), spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._cut_path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)
