"""Make this package importable in Python workers, and cut long lineages."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of a batch of rows between the JVM and a Python worker, unless the session sets others: both sides hold a few.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def ship(spark: SparkSession) -> None:
    """Add the package to the context's Python files, once, so that executors need no shared installation; bound the batches that
    workers get, where the session leaves that to Spark's default."""
    sc = spark.sparkContext
    if sc.getConf().get(BATCH_BYTES[0]) is None:
        spark.conf.set(*BATCH_BYTES)
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    made = shutil.make_archive(os.path.join(folder, home.name), "zip", home.parent, home.name)
    sc.addPyFile(made)
    _shipped.add(sc.applicationId)


#: Bytes of stored input for each partition of a shuffle, and of a shuffle for each task that reads it.
INPUT_BYTES, TASK_BYTES = 2 << 20, 8 << 20
_ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def spread(spark: SparkSession, path: str) -> None:
    """Let shuffles have as many partitions as the table at path asks for, never fewer than they had, and tasks read no more than
    TASK_BYTES of them at once, where the session leaves that to Spark's default: a task's memory then doesn't grow with the input."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stored = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    if stored // INPUT_BYTES > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", stored // INPUT_BYTES)
    if spark.conf.get(_ADVISED) in ("64MB", "67108864b", str(64 << 20)):
        spark.conf.set(_ADVISED, TASK_BYTES)


_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may lack it; it gets one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut_lineage(df: DataFrame, tag: str = "table") -> DataFrame:
    """df written as Parquet in the shared folder and read back: what follows neither repeats its work nor begins again when
    an executor is lost. The table is deleted when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def cut_dealt(df: DataFrame, keys: list[str], tag: str = "table") -> DataFrame:
    """`cut_lineage` with the rows dealt out by keys into buckets, as many as a shuffle has partitions: what is worked out of the
    table by those keys, and joined under `dealt_joins`, needs no shuffle. A key's rows lie in one bucket, whose tasks sort and
    spill them."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).format("parquet").saveAsTable(name)
    remove_at_exit(spark, path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay until the process ends
    return out


@contextmanager
def dealt_joins(spark: SparkSession) -> Iterator[None]:
    """Joins that are planned within leave sides where they are that lie together by some of the join's keys; tables of `cut_dealt`
    are read by their buckets throughout, and none is sent to all executors instead, however small its columns are stored."""
    wanted = {
        "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {n: spark.conf.get(n, None) for n in wanted}
    for n, v in wanted.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    if not _written:
        atexit.register(remove_written)
    _written.append((spark, path))


def remove_written() -> None:
    """Delete what this process wrote in the shared folder."""
    while _written:
        spark, path = _written.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is scratch space
            return
