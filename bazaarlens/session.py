"""Session settings the jobs rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a table that is dealt by a key, at most: each task that writes has a file for each.
KEY_PARTS = 256
#: A part with more bytes than this, and four times as many as the others, holds a hot key.
LARGE_PART = 64 << 20

SETTINGS = {
    # Buckets are UTC.
    "spark.sql.session.timeZone": "UTC",
    # A repeated field in a payload keeps its last value instead of voiding the payload.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # The JVM interprets longer methods and never compiles them.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Many small parts, merged again where they are small, so that a task's share doesn't grow with
    # the input. The first also bounds what is sorted before a shuffle.
    "spark.sql.files.maxPartitionBytes": "16m",
    # A table dealt by a key has many small files.
    "spark.sql.files.openCostInBytes": "512k",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    # Ids and hashes are hexadecimal text, which snappy leaves as it is.
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    cores: str = "8", memory: str = "8g", partitions: int = 8, debugging: bool = False
) -> SparkSession:
    """Session for tests and the bench. On a cluster use spark-submit and ``configure``.

    ``debugging`` keeps PySpark's capture of the call site of every column expression, which
    costs seconds of plan building on the larger jobs.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bazaarlens")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", str(debugging).lower())
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the cluster's shared checkpoint folder, spark.checkpoint.dir.

    Where it is unset, a session on one machine (tests, bench) uses a temporary folder; on a
    cluster that is an error, for executors don't share local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="bazaarlens-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and safe from lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def written_by(df: DataFrame, key: str, purpose: str, parts: int) -> DataFrame:
    """``written``, dealt by ``key``."""
    return dealt_at(shared_folder(df.sparkSession, purpose), df, key, parts)


def dealt_at(path: str, df: DataFrame, key: str, parts: int, spark: SparkSession | None = None) -> DataFrame:
    """The frame as a table at a new path, dealt by ``key`` into parts (KEY_PARTS at most): what groups
    or joins by the key reads a part in each task, and no row goes through a shuffle, which takes
    twice the table's size. It is read by ``spark``, the frame's own session unless given.

    Where a hot key makes one part much larger than the others, the table is read by file splits
    like any other, so that the key's rows are combined in many tasks before they meet.
    """
    spark = spark or df.sparkSession
    name = f"dealt_{uuid.uuid4().hex}"
    parts = max(1, min(parts, KEY_PARTS))
    df.write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(name)
    dealt = spark.table(name)
    spark.sql(f"DROP TABLE `{name}`")  # the name only: the files stay, and so does what reads them
    part = F.regexp_extract("path", r"_(\d+)\.c\d+", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    sizes = files.groupBy(part).agg(F.sum("length").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    hot = (sizes.most or 0) > max(LARGE_PART, 4 * (sizes["all"] or 0) / parts)
    return spark.read.schema(df.schema).parquet(path) if hot else dealt
