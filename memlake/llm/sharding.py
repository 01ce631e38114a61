"""Sharding by a Feistel permutation with cycle walking over global row numbers (native).

Rows are numbered 0..N-1 in the order of (hash bucket, doc_id, text CRC, size), which
their content and N decide; a generalised Feistel network on Z_a x Z_b, the smallest a * b >= N near the square root, walks
until it lands below N. The image is the row's place in the shuffle: shard and
slot are its remainder and quotient by the number of shards, so shard counts
differ by one at most, slots have no gaps, and all of it can be recomputed from
N, the seed and the row number alone.

Scale: only ids, sizes and checksums are shuffled, never texts. Rows alike are
counted before they are shuffled and numbered as one run, so neither a spread of ids
nor a repeated row fills a bucket. Row numbers come from counts by bucket (a window
inside each of some 1024 rows, running sums over buckets in two levels); the upper
one is a task's work over a millionth of the rows.

Defined cases: null text: size 1, CRC 0. Null ids are numbered like others. Equal
rows get places of their own, in any order among themselves. Ids of any size serve.
An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6


def domain(n: int, tries: int = 4096) -> tuple[int, int]:
    """(a, b) with a * b >= n, of least excess among the a next to the square root: that bounds the walk."""
    r = max(1, math.isqrt(n))
    return min(((a, -(-n // a)) for a in range(r, min(r + tries, n) + 1)), key=lambda x: (x[0] * x[1] - n, x[0]), default=(1, 1))


def permuted(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass through the network: a bijection of 0..a*b-1."""
    v = x % b
    u = F.call_function("div", x, F.lit(b).cast("long"))
    for k in range(ROUNDS):
        # each round reads its half once: the expression stays small
        half, m = (v, a) if k % 2 == 0 else (u, b)
        turn = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), half), F.lit(m).cast("long"))
        if k % 2 == 0:
            u = (u + turn) % a
        else:
            v = (v + turn) % b
    return u * b + v


def row_numbers(df: DataFrame, rows_in_bucket: int = 1024, together: int = 1 << 16) -> tuple[DataFrame, int]:
    """``df`` (doc_id, text_crc32, size) with a global, gapless ``row_number``, and the number of rows."""
    key = ["doc_id", "text_crc32", "size"]
    alike = df.groupBy(*key).agg(F.count("*").alias("c"))
    n = df.count()
    buckets = max(1, -(-n // rows_in_bucket))
    alike = alike.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets).cast("long")))
    counts = alike.groupBy("bucket").agg(F.sum("c").alias("c")).withColumn("upper", F.expr("bucket div 1024"))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    above = counts.groupBy("upper").agg(F.sum("c").alias("t")).select("upper", F.coalesce(F.sum("t").over(earlier("upper")), F.lit(0)).alias("base"))
    first = counts.withColumn("before", F.coalesce(F.sum("c").over(earlier("upper", "bucket")), F.lit(0))).join(above, "upper").select("bucket", (F.col("base") + F.col("before")).alias("first"))
    inside = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("rn", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(first, "bucket").withColumn("first", F.col("first") + F.col("rn"))
    # rows alike take a run of numbers; a long run is made in several tasks
    runs = placed.select(*key, "first", "c", F.explode(F.expr(f"sequence(0L, (c - 1) div {together}L)")).alias("run")).repartition("run", *key)
    each = F.expr(f"sequence(first + run * {together}L, first + least(c, (run + 1) * {together}L) - 1)")
    return runs.select(*key, F.explode(each).alias("row_number")), n


def feistel_shards(docs: DataFrame, shards: int = 8, seed: int = 20240229) -> DataFrame:
    """doc_id, size, text_crc32, row_number, place, shard, slot."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows, n = row_numbers(rows)
    a, b = domain(n)
    place = permuted(F.col("row_number"), a, b, seed)
    if excess := a * b - n:
        # at most ``excess`` places lie outside 0..n-1, so no walk is longer
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(excess)), place, lambda x, _: F.when(x < n, x).otherwise(permuted(x, a, b, seed)))
        place = walk
    return rows.withColumn("place", place).withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.expr(f"place div {shards}L"))
