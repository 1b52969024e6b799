"""What a write strategy returns, and how its next state is put on storage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablesync.session import discard, scratch_dir, stored

ACTION = "_action"
KEEP, INSERT, UPDATE, DELETE = "keep", "insert", "update", "delete"


@dataclass(frozen=True)
class WriteOutcome:
    """The rows of a table after a write, each tagged with what happened to it.

    ``tagged`` holds the table's columns plus ``_action``. ``state`` may name a
    cheaper plan for the same next state. Nothing has run yet.
    """

    strategy: str
    tagged: DataFrame
    columns: tuple[str, ...]
    keys: tuple[str, ...] = ()
    state: DataFrame | None = None

    @property
    def next_state(self) -> DataFrame:
        if self.state is not None:
            return self.state
        return self.tagged.where(F.col(ACTION) != DELETE).select(*self.columns)

    @property
    def metrics(self) -> DataFrame:
        """One row ``(strategy, rows_inserted, rows_updated, rows_deleted)``.

        With ``keys`` set, updates count source records: a record that changed
        several rows counts once.
        """
        updated = F.count_if(F.col(ACTION) == UPDATE)
        if self.keys:
            hit = F.when(F.col(ACTION) == UPDATE, F.struct(*self.keys))
            updated = F.count_distinct(hit)
        return self.tagged.agg(
            F.count_if(F.col(ACTION) == INSERT).alias("rows_inserted"),
            updated.alias("rows_updated"),
            F.count_if(F.col(ACTION) == DELETE).alias("rows_deleted"),
        ).select(F.lit(self.strategy).alias("strategy"), "rows_inserted", "rows_updated", "rows_deleted")

    def write(self, path: str, *, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> dict:
        """Write the next state to a path it does not read from, and give the row of
        ``metrics`` as a dict.

        The counts are observed in the stage that writes, so they cost no second
        pass and a retried task is counted once; with ``keys`` set, the merge is kept in
        scratch between counting and writing. With ``partition_by``, rows are
        first gathered by those columns; AQE splits a partition that holds most of
        them over several files.
        """
        if self.keys:
            spark = self.tagged.sparkSession
            scratch = scratch_dir(spark, "merged")
            try:
                merged = replace(self, tagged=stored(self.tagged, scratch), state=None)
                counts = merged.metrics.first().asDict()
                state = gathered(merged.next_state, partition_by)
                state.write.mode(mode).partitionBy(*partition_by).parquet(path)
            finally:
                discard(spark, scratch)
            return counts
        seen = Observation("write_counts")
        observed = gathered(self.tagged, partition_by).observe(
            seen,
            F.count_if(F.col(ACTION) == INSERT).alias("rows_inserted"),
            F.count_if(F.col(ACTION) == UPDATE).alias("rows_updated"),
            F.count_if(F.col(ACTION) == DELETE).alias("rows_deleted"),
        )
        state = observed.where(F.col(ACTION) != DELETE).select(*self.columns)
        state.write.mode(mode).partitionBy(*partition_by).parquet(path)
        return {"strategy": self.strategy, **seen.get}


def gathered(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows laid out for a partitioned write: few files per partition, none too large."""
    return df.hint("rebalance", *partition_by) if partition_by else df


def tag(df: DataFrame, action: str) -> DataFrame:
    return df.withColumn(ACTION, F.lit(action))
