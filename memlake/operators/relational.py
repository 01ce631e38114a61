"""State changes, paging, ranking and statistics over memory tables: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.shared import stored


def active() -> Column:
    return F.col("is_latest") & ~F.col("is_forgotten")


def tenant(tag: Column, key: str) -> Column:
    """The key's container or one of its projects; the underscore of LIKE stands for any character."""
    return (tag == key) | tag.like(f"{key}_%")


def scoped(scope: Column, wanted: str | None) -> Column:
    return scope.isNull() if wanted is None else (scope == wanted) | scope.isNull()


def insert_absent(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet; the first of equal keys."""
    new = rows.dropDuplicates(keys).join(state.select(*keys), keys, "left_anti")
    return state.unionByName(new)


def upsert(state: DataFrame, rows: DataFrame, keys: list[str], counter: str | None = None) -> DataFrame:
    """New values where not null, else the old; a counter grows by the new row's."""
    values = [c for c in state.columns if c not in keys]
    new = rows.select(*keys, *[F.col(c).alias(f"__{c}") for c in values])
    out = state.join(new, keys, "full_outer")
    pick = [(F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(c) if c == counter else F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) for c in values]
    return out.select(*keys, *pick)


def delete_cascade(parent: DataFrame, children: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    out = {"parent": parent.join(gone.select(key), key, "left_anti")}
    for name, (child, column) in children.items():
        out[name] = child.join(gone.select(F.col(key).alias(column)), column, "left_anti")
    return out


def retained(df: DataFrame, column: str, now: str, days: int = 7) -> DataFrame:
    return df.where(F.col(column) >= F.expr(f"timestamp_ntz'{now}' - interval {days} days"))


def top_per_key(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= n)


def keyset_page(df: DataFrame, columns: list[str], after: tuple, n: int) -> DataFrame:
    """Rows below a cursor in descending order, one more than the page to tell whether there is a next."""
    low = F.struct(*[F.col(c) for c in columns]) < F.struct(*[F.lit(v).cast(df.schema[c].dataType) for c, v in zip(columns, after)])
    return df.where(low).orderBy(*[F.desc(c) for c in columns]).limit(n + 1)


def timeline(df: DataFrame, ts: str, unit: str, start: str, end: str, zone: str = "UTC") -> DataFrame:
    """Counts by day, week or month of a zone, with zeros where nothing was."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)
    seen = df.groupBy(F.date_trunc(unit, local).cast("date").alias("bucket")).agg(F.count("*").alias("n"))
    span = df.sparkSession.sql(f"select explode(sequence(date(date_trunc('{unit}', date'{start}')), date(date_trunc('{unit}', date'{end}')), interval 1 {unit})) as bucket")
    return span.join(seen, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def percentile_report(df: DataFrame, column: str) -> list[Column]:
    return [F.count("*").alias("n"), F.round(F.avg(column), 1).alias("avg_ms"), F.round(F.expr(f"percentile_cont(0.95) within group (order by {column})"), 4).alias("p95_ms")]


#: Characters of needles that are broadcast at once.
NEEDLES = 8_000_000


def containing(texts: DataFrame, needles: DataFrame, most: int = NEEDLES) -> DataFrame:
    """All pairs of a row of ``texts`` (text, ..) and one of ``needles`` (needle, ..) that stands in it. Needles are few and short; where they have more than ``most`` characters they go in blocks, each a scan of the texts. An empty needle stands in every text, a null one in none."""
    total = needles.agg(F.sum(F.length("needle") + 32)).first()[0] or 0
    parts = max(1, -(-total // most))
    out = None
    for k in range(parts):
        part = needles if parts == 1 else needles.where(F.pmod(F.xxhash64("needle", F.monotonically_increasing_id()), F.lit(parts)) == k)
        now = texts.join(F.broadcast(part), F.col("text").contains(F.col("needle")))
        out = now if out is None else out.unionByName(now)
    return out


def numbered(df: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """``df`` with ``row_number`` (from 1) by a key without repetitions: numbers inside ranges of the key, after the sizes of the ranges before."""
    ranged = stored(df.repartitionByRange(parts, key).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    return ranged.withColumn("__in", inside).join(F.broadcast(sizes), "__part").withColumn("row_number", F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def scan_pages(df: DataFrame, key: str, rows: int) -> DataFrame:
    """page, after, last, n: where each page of a scan by key begins (after which key) and ends: a scan that broke off after ``last`` goes on with the page whose ``after`` that is."""
    pages = numbered(df.select(key), key).groupBy(F.expr(f"(row_number - 1) div {rows}").alias("page")).agg(F.max(key).alias("last"), F.count("*").alias("n"))
    before = pages.select((F.col("page") + 1).alias("page"), F.col("last").alias("after"))
    return pages.join(before, "page", "left").select("page", "after", "last", "n")
