"""Session defaults, scratch locations and the one size check behind plan choices."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans skewed and small joins at run time; ANSI makes a bad cast fail.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


SHUFFLE_PARTITION_BYTES = 128 * 1024**2


def build_session(
    app_name: str = "tablesync", master: str | None = None, shuffle_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the defaults above.

    ``shuffle_bytes``, the size of the largest input that is shuffled, sets the
    number of shuffle partitions so that each is about 128 MB before AQE merges
    the small ones.
    """
    if shuffle_bytes:
        partitions = max(200, -(-shuffle_bytes // SHUFFLE_PARTITION_BYTES))
        conf = {"spark.sql.shuffle.partitions": str(partitions), **conf}
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """What the session names as the folder that driver and executors share."""
    return spark.conf.get("spark.checkpoint.dir", None)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new, unused directory on the storage all executors share.

    The parent is ``spark.checkpoint.dir``. Only a local master may do without
    that setting; it then gets a temporary folder that is removed at exit.
    """
    parent = shared_folder(spark)
    if not parent:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        parent = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, parent, ignore_errors=True)
    app = spark.sparkContext.applicationId
    return f"{parent.rstrip('/')}/tablesync-{app}/{name}-{uuid.uuid4().hex}"


def fits_broadcast(df: DataFrame) -> bool:
    """True when Catalyst's size estimate of ``df`` is under the broadcast threshold.

    Joins multiply and filters never lower the estimate, so it errs on the large
    side. A frame that passes is one Spark would broadcast without a hint; one
    that does not takes the shuffled form of the same operator.
    """
    state = df.sparkSession._jsparkSession.sessionState()
    threshold = state.conf().autoBroadcastJoinThreshold()
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(estimate)) <= threshold


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to a new ``path`` on shared storage and read it back: a cut in the
    lineage that survives the loss of executors and gives later plans real file sizes."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch directory this application made."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch folders of this application. Frames that operators gave it can't be read afterwards, so
    this is for the end of a job, or between two."""
    parent = shared_folder(spark)
    if parent:
        discard(spark, f"{parent.rstrip('/')}/tablesync-{spark.sparkContext.applicationId}")
