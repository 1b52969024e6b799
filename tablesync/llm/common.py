"""What several operators share: words, columns with reserved names, materialised steps, global order."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablesync.session import scratch_dir, stored

# White space of the contracts: these six characters, nothing else.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder executors share and read back: later plans know its size,
    and a lost executor costs no more than the tasks it ran."""
    return stored(df, scratch_dir(df.sparkSession, name))


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this library to the executors, once per application, for operators that run Python there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for columns to be added that none of ``df`` has, in any case: underscores go in front of taken ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def by_merge(table: DataFrame) -> DataFrame:
    """For the side that meets whole texts: a merge join at every size, so that what a small table lets
    pass as a broadcast is not a surprise where the table has grown."""
    return table.hint("merge")


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text, in order; none for NULL."""
    return F.array_remove(F.split(whole(text), f"{SPACE}+"), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def strip_space(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def indices(n: Column) -> Column:
    """0 .. n-1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def numbered(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """``df`` with its rows numbered from 0 in the order given, without a one-task sort.

    Rows are range-partitioned and numbered inside partitions; an offset per
    partition is added. The table of offsets has one row per partition.
    """
    placed = cut(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered"
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_at", within).join(offsets, "_part").withColumn(
        name, F.col("_before") + F.col("_at")
    ).drop("_part", "_at", "_before")
