"""Evidence to claims as a stream: every micro-batch makes the next version of the derived layer.

A batch's version follows from its number and the version before it, so a batch that
broke off and is run again writes the same version again. ``judge`` makes the judgements
of a batch's evidence from the claims that are there (in the tests: a table of them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from memlake.operators import claims, migration


def reconciled(evidence: DataFrame, path: str, judge: Callable[[DataFrame, dict[str, DataFrame]], DataFrame], checkpoint: str) -> DataStreamWriter:
    """A writer that keeps the claims at ``path`` up to a stream of evidence. Start it with any trigger."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = migration.current(spark, path, number) if number else claims.empty_state(spark)
        batch.persist()
        after = claims.applied(state, batch, judge(batch, state))
        migration.swap(after, path, number + 1)
        batch.unpersist()

    return evidence.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
