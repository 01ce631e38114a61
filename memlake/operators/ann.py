"""Vector search in blocks: exact over all rows, or approximate over the lists of an index.

The index is an inverted file: centroids are fitted on a bounded sample, every row
goes to the list of its nearest centroid, and the table of lists is written once. A
query looks at its ``probes`` nearest lists; what it sees there is scored exactly.
With ``probes=None`` it sees all lists.

Both ways compare blocks of queries with blocks of rows by one matrix product each,
and hand on the best ``k`` of a block for each query. A block has at most some
``ROWS`` rows and ``QUERIES`` queries: a list that holds a third of all rows is many
blocks, and a set of queries that grows with the data only makes more of them.

Defined cases: a null vector is never found and finds nothing. A zero vector or one
of another length has similarity 0; the index leaves such rows out, the exact search
doesn't. Equal similarities (to 9 places) are ordered by id, or by ``ord`` if the
corpus has that column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.vectors import norm
from memlake.operators.shared import new_path

ROWS = 4096
QUERIES = 4096
#: Queries of a block that are compared at once: what a task holds of their similarities grows no further.
AT_ONCE = 128
#: Rows that centroids are fitted on, and lists, at most.
SAMPLE = 20_000
MOST_LISTS = 1024


# ---------------------------------------------------------------- one block
def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column padded with zeros to the longest, and their lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(n.max()) if len(n) else 0
    if (n == width).all():
        return flat.reshape(len(n), width), n
    out = np.zeros((len(n), width))
    out[np.arange(width)[None, :] < n[:, None]] = flat
    return out, n


def similarities(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Cosines of all pairs; 0 where a vector is zero or lengths differ."""
    (q, nq), (v, nv) = queries, rows
    width = min(q.shape[1], v.shape[1])
    dots = q[:, :width] @ v[:, :width].T
    size = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None, :]
    return np.where((nq[:, None] == nv[None, :]) & (size > 0), dots / np.where(size > 0, size, 1), 0.0)


def best(score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best scores, ties (to 9 places) by ``order``."""
    score = np.round(score, 9)
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, -k)[-k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((order[at], -score[at]))][:k]


_FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64()), ("score", pa.float64()), ("ord", pa.int64())])


def _compare(queries: DataFrame, rows: DataFrame, by: list[str], k: int, least: float | None, strict: bool, but_self: bool) -> DataFrame:
    """The best ``k`` of every block for every query. queries (query_id, query_vec, by..), rows (id, vec, weight, ord, by..)."""

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in _FOUND]
        if len(left) and len(right):
            ids, weight, order = (right.column(c).to_numpy() for c in ("id", "weight", "ord"))
            vectors, queries_ = _matrix(right.column("vec")), left.column("query_id").to_pylist()
            for lo in range(0, len(left), AT_ONCE):
                s = similarities(_matrix(left.column("query_vec").slice(lo, AT_ONCE)), vectors)
                final = np.where(np.isnan(weight)[None, :], s, (s + 1) / 2 * weight[None, :])
                for r, query in enumerate(queries_[lo : lo + AT_ONCE]):
                    seen = np.ones(len(ids), bool) if least is None else s[r] > least if strict else s[r] >= least
                    if but_self:
                        seen &= ids != query
                    at = np.flatnonzero(seen)
                    at = at[best(final[r][at], order[at], k)] if len(at) else at
                    for column, values in zip(out, (np.full(len(at), query), ids[at], s[r][at], final[r][at], order[at])):
                        column.append(values)
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, _FOUND.types)], schema=_FOUND)

    return queries.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(block, "query_id long, id long, similarity double, score double, ord long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "ord")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("ord")


def _rows(corpus: DataFrame) -> DataFrame:
    """id, vec, weight, ord of a corpus that may lack the last two."""
    out = corpus.where("vec is not null").withColumns({"id": F.col("id").cast("long"), "vec": F.col("vec").cast("array<double>")})
    if "weight" not in corpus.columns:
        out = out.withColumn("weight", F.lit(float("nan")))
    return out if "ord" in corpus.columns else out.withColumn("ord", F.col("id"))


def exact_top_k(queries: DataFrame, corpus: DataFrame, k: int = 10, least: float | None = None, strict: bool = False, but_self: bool = False, by: list[str] | None = None) -> DataFrame:
    """query_id, id, similarity, score, rank: a stated query set (query_id, query_vec) against all rows (id, vec).

    Rows whose ``by`` columns equal the query's are compared. A corpus with ``weight`` is
    ranked by (similarity + 1) / 2 * weight, without it by similarity.
    """
    by = by or []
    q = queries.where("query_vec is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vec").cast("array<double>").alias("query_vec"), *by)
    v = _rows(corpus).select("id", "vec", "weight", "ord", *by)
    parts, q_parts = max(1, -(-v.count() // ROWS)), max(1, -(-q.count() // QUERIES))
    # every block of queries meets every block of rows
    q = q.withColumn("__q", F.pmod(F.xxhash64("query_id"), F.lit(q_parts)).cast("int")).withColumn("__v", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    v = v.withColumn("__v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))))
    return _ranked(_compare(q, v, [*by, "__v", "__q"], k, least, strict, but_self), k)


def pairs(corpus: DataFrame, least: float, by: list[str] | None = None) -> DataFrame:
    """id, other, similarity of all pairs (id < other) of rows (id, vec) with equal ``by`` columns and a similarity of ``least`` or more."""
    by = by or []
    v = corpus.where("vec is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), *by)
    parts = max(1, -(-v.count() // ROWS))
    v = v.withColumn("__p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    left = v.withColumn("__i", F.col("__p")).withColumn("__j", F.explode(F.sequence(F.col("__p"), F.lit(parts - 1))))
    right = v.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__p")))).withColumn("__j", F.col("__p"))
    right = right.select(F.col("id").alias("other"), F.col("vec").alias("other_vec"), *(F.col(c).alias(c) for c in [*by, "__i", "__j"]))
    schema = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("similarity", pa.float64())])

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return schema.empty_table()
        x, y = a.column("id").to_numpy(), b.column("other").to_numpy()
        same = a.column("__i")[0].as_py() == a.column("__j")[0].as_py()
        others, out = _matrix(b.column("other_vec")), []
        for lo in range(0, len(a), AT_ONCE):
            s = similarities(_matrix(a.column("vec").slice(lo, AT_ONCE)), others)
            seen = s >= least
            if same:
                seen &= x[lo : lo + AT_ONCE, None] < y[None, :]
            r, c = np.nonzero(seen)
            out.append((np.minimum(x[lo + r], y[c]), np.maximum(x[lo + r], y[c]), s[r, c]))
        return pa.table([np.concatenate(v) for v in zip(*out)], schema=schema)

    keys = [*by, "__i", "__j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, "id long, other long, similarity double")


# ---------------------------------------------------------------- the index
@dataclass
class Index:
    """Lists of an inverted file: the table of rows (list, part, id, vec) and what is known of each list."""

    path: str
    centroids: np.ndarray
    parts: list[int]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")


def _nearest(centroids: np.ndarray, column: pa.Array, n: int) -> np.ndarray:
    """Places of the ``n`` nearest centroids of each vector, nearest first."""
    v, _ = _matrix(column)
    near = v @ centroids.T
    return np.argsort(-near, axis=1, kind="stable")[:, :n]


def _direction(c: str, dims: int) -> Column:
    return (F.size(c) == dims) & (norm(F.col(c)) > 0)


def fit(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of unit length from at most ``sample`` rows (those of the least hashes): the number of lists is the root of the number of rows, unless given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = vectors.where("vec is not null and size(vec) > 0").where(norm(F.col("vec")) > 0)
    shape = usable.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims")).first()
    if not shape.n:
        return np.zeros((1, 1))
    k = max(1, min(lists or math.isqrt(shape.n), MOST_LISTS, sample, shape.n))
    rows = usable.where(F.size("vec") == shape.dims).orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    if k == 1:
        return np.ones((1, shape.dims))
    found = KMeans(k=k, distanceMeasure="cosine", maxIter=10, initMode="random", seed=7).fit(rows.cache()).clusterCenters()
    rows.unpersist()
    c = np.stack(found)
    return c / np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)


def build(vectors: DataFrame, path: str | None = None, lists: int | None = None, sample: int = SAMPLE) -> Index:
    """The index of all rows (id, vec) that have a direction, written to ``path``."""
    spark = vectors.sparkSession
    path = path or new_path(spark, "ann")
    centroids = fit(vectors, lists, sample)
    schema = pa.schema([("list", pa.int32()), ("id", pa.int64()), ("vec", pa.list_(pa.float64()))])

    def assign(batches):
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(_nearest(centroids, b.column(1), 1)[:, 0], pa.int32()), b.column(0), b.column(1).cast(schema.field("vec").type)], schema=schema)

    rows = vectors.where("vec is not null").where(_direction("vec", centroids.shape[1])).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    rows.mapInArrow(assign, "list int, id long, vec array<double>").write.parquet(f"{path}/assigned")
    assigned = spark.read.parquet(f"{path}/assigned")
    parts = [1] * len(centroids)
    for r in assigned.groupBy("list").count().collect():  # a row for each list
        parts[r["list"]] = -(-r["count"] // ROWS)
    known = spark.createDataFrame([(k, c.tolist(), p) for k, (c, p) in enumerate(zip(centroids, parts))], "list int, centroid array<double>, parts int")
    known.coalesce(1).write.parquet(f"{path}/lists")
    part = F.pmod(F.xxhash64("id"), F.element_at(F.lit(parts), F.col("list") + 1)).cast("int")
    assigned.withColumn("part", part).repartition("list", "part").sortWithinPartitions("list", "part").write.parquet(f"{path}/rows")
    return Index(path, centroids, parts)


def opened(spark: SparkSession, path: str) -> Index:
    """An index written before."""
    rows = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
    return Index(path, np.asarray([r.centroid for r in rows]), [r.parts for r in rows])


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = 16, least: float | None = None, but_self: bool = False) -> DataFrame:
    """query_id, id, similarity, score, rank of the best rows in the ``probes`` nearest lists of each query (query_id, query_vec)."""
    spark = queries.sparkSession
    centroids, n = index.centroids, min(probes or len(index.centroids), len(index.centroids))
    schema = pa.schema([("query_id", pa.int64()), ("query_vec", pa.list_(pa.float64())), ("list", pa.int32())])

    def probed(batches):
        for b in batches:
            if len(b):
                lists = _nearest(centroids, b.column(1), n)
                at = pa.array(np.repeat(np.arange(len(b)), n))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(lists.ravel(), pa.int32())], schema=schema)

    q = queries.where("query_vec is not null").where(_direction("query_vec", centroids.shape[1])).select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vec").cast("array<double>").alias("query_vec"))
    q_parts = max(1, -(-q.count() // QUERIES))
    q = q.mapInArrow(probed, "query_id long, query_vec array<double>, list int").withColumn("qpart", F.pmod(F.xxhash64("query_id"), F.lit(q_parts)).cast("int"))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(F.lit(index.parts), F.col("list") + 1) - 1)))
    v = _rows(index.rows(spark)).withColumn("qpart", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))))
    return _ranked(_compare(q, v, ["list", "part", "qpart"], k, least, False, but_self), k)


def calibrated(index: Index, vectors: DataFrame, target: float = 0.95, k: int = 10, sample: int = 256) -> int:
    """How many lists a query has to look at so that ``target`` of the ``k`` nearest rows are in them: measured for at most ``sample`` rows (those of the least hashes) against all rows."""
    spark, centroids = vectors.sparkSession, index.centroids
    own = vectors.where("vec is not null").where(_direction("vec", centroids.shape[1]))
    queries = own.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(sample).select(F.col("id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("query_vec"))
    near = exact_top_k(queries, own, k, but_self=True).join(index.rows(spark).select("id", "list"), "id").select("query_id", "list")
    schema = pa.schema([("place", pa.int32())])

    def places(batches):
        for b in batches:
            if len(b):
                order = _nearest(centroids, b.column(1), len(centroids))
                yield pa.RecordBatch.from_arrays([pa.array(np.argmax(order == b.column(0).to_numpy()[:, None], axis=1), pa.int32())], schema=schema)

    counts = np.zeros(len(centroids))
    for r in near.join(queries, "query_id").select("list", "query_vec").mapInArrow(places, "place int").groupBy("place").count().collect():  # a row for each list
        counts[r.place] = r["count"]
    return 1 + int(np.searchsorted(np.cumsum(counts), target * counts.sum() - 1e-9)) if counts.any() else 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, n, n_found, recall: which of the exact neighbours were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n"))
