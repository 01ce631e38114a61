"""Memories to evidence, batch by batch, so that a run that broke off can go on; and the derived claims as one table swap.

A run's folder holds ``evidence/batch=<n>`` and ``state/batch=<n>``. A batch's evidence is
written first and its state (the last id, and the counts) after it, so a batch without
a state is written again, over what is there. Batches are ranges of ids, each one
job over many rows; what belongs to a batch follows from the table and the state before
it alone. Evidence that any run has written is not written twice.

A rebuilt layer of claims is written beside the old one as a new version; a small
table of versions is appended to last, and readers take the latest version named there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.text import migration_key

BATCH_ROWS = 1_000_000


def owners(tags: DataFrame, keys: DataFrame) -> DataFrame:
    """container_tag -> owner_id, scope. A tag is a key (no scope) or a key with ``_project-<dir>``; others have no owner. keys: key_id, is_active."""
    active = keys.where("is_active").select(F.col("key_id").alias("owner_id")).distinct()
    at = F.instr("container_tag", "_project-")
    both = tags.select("container_tag").distinct().withColumn("owner_id", F.when(at > 1, F.expr("substring(container_tag, 1, instr(container_tag, '_project-') - 1)")).otherwise(F.col("container_tag")))
    scope = F.when(at > 1, F.expr("substring(container_tag, instr(container_tag, '_project-') + 1)"))
    return both.join(active, "owner_id", "left_semi").select("container_tag", "owner_id", scope.alias("scope"))


def as_evidence(memories: DataFrame, keys: DataFrame) -> DataFrame:
    """The evidence of current memories (id, container_tag, content, created_at, is_latest, is_forgotten) that have an owner."""
    live = memories.where(F.coalesce("is_latest", F.lit(False)) & ~F.coalesce("is_forgotten", F.lit(True)))
    key = migration_key(F.col("id"))
    out = live.join(owners(live, keys), "container_tag")
    return out.select(F.concat(F.lit("ev_"), key).alias("evidence_id"), F.col("created_at").alias("observed_at"), F.lit("agent_add").alias("source_kind"), "content", "scope", F.lit("personal").alias("owner_type"), "owner_id", F.col("id").alias("migrated_from_memory_id"), F.lit("paraphrase").alias("extraction_type"), key.alias("idempotency_key"), F.lit("pending").alias("processing_state"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_STATE = "run_id string, last_memory_id string, total long, migrated long, skipped long, status string, batch int"


def state_of(spark: SparkSession, path: str) -> DataFrame:
    """A row for each batch that is done."""
    return spark.read.schema(_STATE).parquet(f"{path}/state") if _exists(spark, f"{path}/state") else spark.createDataFrame([], _STATE)


def migrated(spark: SparkSession, path: str) -> DataFrame:
    """Evidence of the batches that are done; what a broken batch left is not seen."""
    done = state_of(spark, path).select("batch")
    return spark.read.parquet(f"{path}/evidence").join(done, "batch", "left_semi") if _exists(spark, f"{path}/evidence") else None


def migrate(memories: DataFrame, keys: DataFrame, path: str, run_id: str, known: DataFrame | None = None, batch_rows: int = BATCH_ROWS, stop_after: int | None = None, between=lambda batch: None) -> dict:
    """Write the evidence of ``memories`` to ``path``, going on after the last batch that is done there. known: evidence (idempotency_key) of other runs.

    ``stop_after`` ends a run early after so many batches; ``between`` is called when a
    batch's evidence is written and its state isn't (tests break off there).
    """
    spark = memories.sparkSession
    live = memories.where(F.coalesce("is_latest", F.lit(False)) & ~F.coalesce("is_forgotten", F.lit(True)) & F.col("id").isNotNull())
    done = state_of(spark, path)
    last = done.orderBy(F.desc("batch")).first()
    if last is not None and last.status == "done":
        return totals(spark, path)
    total = live.count()
    if total == 0:
        return {"run_id": run_id, "total": 0, "migrated": 0, "skipped": 0, "status": "done"}
    at, batch, n = (last.last_memory_id if last else ""), (last.batch + 1 if last else 0), 0
    while True:
        rest = live.where(F.col("id") > at)
        # the id of the last row of the batch; nothing but one row comes to the driver
        end = rest.select("id").orderBy("id").limit(batch_rows).agg(F.max("id").alias("id"), F.count("*").alias("n")).first()
        part = rest.where(F.col("id") <= (end.id or at))
        rows = as_evidence(part, keys)
        if known is not None:
            rows = rows.join(known.select("idempotency_key").distinct(), "idempotency_key", "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/evidence/batch={batch}")
        between(batch)
        written = spark.read.parquet(f"{path}/evidence/batch={batch}").count()
        status = "done" if end.n < batch_rows else "running"
        spark.createDataFrame([(run_id, end.id or at, total, written, end.n - written, status)], _STATE.rsplit(",", 1)[0]).coalesce(1).write.mode("overwrite").parquet(f"{path}/state/batch={batch}")
        at, batch, n = end.id or at, batch + 1, n + 1
        if status == "done" or n == stop_after:
            return totals(spark, path)


def totals(spark: SparkSession, path: str) -> dict:
    s = state_of(spark, path)
    r = s.agg(F.first("run_id").alias("run_id"), F.max_by("total", "batch").alias("total"), F.sum("migrated").alias("migrated"), F.sum("skipped").alias("skipped"), F.max_by("status", "batch").alias("status")).first()
    return r.asDict()


# ---------------------------------------------------------------- the derived layer
def swap(state: dict[str, DataFrame], path: str, version: int | None = None) -> int:
    """Write claims, links and edges as the next version (or the one given, over what a broken run left of it); it counts once its number is in the table of versions."""
    spark = state["claims"].sparkSession
    version = version or (latest(spark, path) or 0) + 1
    for name in ("claims", "links", "edges"):
        state[name].write.mode("overwrite").parquet(f"{path}/{name}/version={version}")
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def latest(spark: SparkSession, path: str) -> int | None:
    return spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0] if _exists(spark, f"{path}/versions") else None


def current(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The state of the latest version, or of the one given."""
    version = version or latest(spark, path)
    return {name: spark.read.parquet(f"{path}/{name}/version={version}") for name in ("claims", "links", "edges")}
