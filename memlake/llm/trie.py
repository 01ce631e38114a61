"""Conversation prefix trie: distributed MSD radix partitioning over turn ids, then multikey quicksort.

Turns (role, text) get ids from a dictionary, in their order. A conversation is its
sequence of ids; conversations alike are one sequence, with their number and the hash
of their ids. A bucket holds the sequences that share a prefix, which is a node of
the trie. A bucket with more turns than a task should take is dealt out by its next
turns (one in the first round, twice as many in each later one, so that long common
prefixes take few rounds), and the nodes on the way come from counts by prefix. As
soon as a bucket is small, one task sorts it by multikey quicksort, and the sort's
recursion emits the nodes below. What subtrees add up to is then carried to the
nodes above along their paths, in one aggregation.

Scale: texts are shuffled for the dictionary alone. Conversations alike are merged
before any bucket is made, and a frequent turn only makes its bucket one that is
dealt out again. A task holds one bucket of at most ``local_turns`` turns, or one
sequence. The hash of a node's conversations reads them in order, in runs of at most
1024 numbers, so a task streams it without holding them. A conversation's ids (16
bytes a turn) are in one row: it may have millions of turns, but not billions.

Defined cases: rows without conv_id belong to no conversation and are left out. Null
role or text is empty. Null turns come first; turns of one number are ordered by role
and text; repeated rows are turns of their own. An empty table has no nodes, not even
a root. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import empty_like, written

#: A bucket of more turns is dealt out further.
LOCAL_TURNS = 16_384
#: Turns of one digit, at most.
MOST_DIGITS = 64
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- sequences
def encoded(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (in order; id and bytes of each) of every conversation."""
    t = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # ids rise with (role, text): written in that order, and numbered by what was written
    dictionary = written(t.select("role", "text").distinct().orderBy("role", "text").withColumn("id", F.monotonically_increasing_id()), "turns")
    one = F.struct("turn", "id", F.octet_length("text").cast("long").alias("bytes"))
    rows = t.join(dictionary, ["role", "text"]).select("conv_id", one.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """conv_id, ids, sizes: the first h turns of the conversation's base, then its own after the first h."""
    base = convs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    own = convs.withColumn("base", F.expr("conv_id - conv_id % 5")).withColumn("h", F.expr("cast(crc32(cast(conv_id as string)) % 9 as int)"))
    both = own.join(base, "base", "left").select("conv_id", F.expr("concat(coalesce(slice(head, 1, h), slice(turns, 1, 0)), slice(turns, h + 1, size(turns)))").alias("t"))
    return both.select("conv_id", F.expr("transform(t, x -> x.id)").alias("ids"), F.expr("transform(t, x -> x.bytes)").alias("sizes"))


_SEQUENCE = "rep long, cnt long, ends string, ids array<long>, sizes array<long>"
_SEQUENCE_ARROW = pa.schema([("rep", pa.int64()), ("cnt", pa.int64()), ("ends", pa.string()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


def sequences(convs: DataFrame) -> DataFrame:
    """Distinct sequences: rep (least conv_id), cnt, ends (SHA-256 of the conv_ids), ids, sizes."""
    runs = convs.groupBy("ids", F.expr("shiftright(conv_id, 10)").alias("run")).agg(F.min("conv_id").alias("rep"), F.count("*").alias("cnt"), F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("names"), F.first("sizes").alias("sizes"))

    def hashed(batches):
        last = digest = None
        row = []
        done = ([], [], [], [], [])

        def close():
            for column, value in zip(done, (row[0], row[1], digest.hexdigest(), last, row[2])):
                column.append(value)

        for b in batches:
            for ids, rep, cnt, names, sizes in zip(*(b.column(k).to_pylist() for k in range(5))):
                if ids == last:
                    row[1] += cnt
                    digest.update(b",")
                else:
                    if last is not None:
                        close()
                    last, digest, row = ids, hashlib.sha256(), [rep, cnt, sizes]
                digest.update(names.encode())
            if len(done[0]) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, _SEQUENCE_ARROW.types)], schema=_SEQUENCE_ARROW)
                done = ([], [], [], [], [])
        if last is not None:
            close()
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, _SEQUENCE_ARROW.types)], schema=_SEQUENCE_ARROW)

    ordered = runs.repartition("ids").sortWithinPartitions("ids", "run")
    return ordered.select("ids", "rep", "cnt", "names", "sizes").mapInArrow(hashed, _SEQUENCE)


# ---------------------------------------------------------------- small buckets
def multikey(rows: list[tuple], depth: int) -> list[list]:
    """Nodes below a bucket's own, in pre-order, from (rep, cnt, ends, ids, sizes) that share their first ``depth`` ids.

    A node: [conv, depth, parent's place (0: the bucket's own), n, ends, saved, children,
    leaves]; the first entry stands for the bucket's own node and holds its sums alone.
    """
    nodes = [[None, depth, -1, 0, None, 0, 0, 0]]
    pick = random.Random(7)
    todo = [([r for r in rows if len(r[3]) > depth], depth, 0)]
    while todo:
        part, d, parent = todo.pop()
        if not part:
            continue
        if len(part) == 1:
            rep, cnt, ends, ids, sizes = part[0]
            for k in range(d, len(ids)):
                nodes.append([rep, k + 1, parent, cnt, ends if k + 1 == len(ids) else None, (cnt - 1) * sizes[k], 0, 0])
                parent = len(nodes) - 1
            continue
        pivot = part[pick.randrange(len(part))][3][d]
        equal = [r for r in part if r[3][d] == pivot]
        if len(equal) < len(part):
            todo.append(([r for r in part if r[3][d] < pivot], d, parent))
            todo.append(([r for r in part if r[3][d] > pivot], d, parent))
        n = sum(r[1] for r in equal)
        nodes.append([min(r[0] for r in equal), d + 1, parent, n, next((r[2] for r in equal if len(r[3]) == d + 1), None), (n - 1) * equal[0][4][d], 0, 0])
        todo.append(([r for r in equal if len(r[3]) > d + 1], d + 1, len(nodes) - 1))
    for node in reversed(nodes):
        node[7] = node[7] or 1
        if node[2] >= 0:
            above = nodes[node[2]]
            above[5] += node[5]
            above[6] += 1
            above[7] += node[7]
    return nodes


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, top boolean"
_NODE_ARROW = pa.schema([(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends", pa.string()), ("top", pa.bool_())])


def finished(closed: DataFrame) -> DataFrame:
    """Nodes below the buckets of ``closed`` (bucket, d and sequences), and with ``top`` what each bucket's own node has below it."""

    def sort(batches):
        out, key, held = [], None, []

        def close():
            nodes = multikey(held, key[1])
            for k, (conv, depth, parent, n, ends, saved, children, leaves) in enumerate(nodes):
                above = None if k == 0 else key[0] if parent == 0 else nodes[parent][0]
                out.append((key[0] if k == 0 else conv, depth, above, n, children, leaves, saved, ends, k == 0))

        for b in batches:
            for bucket, d, *row in zip(*(b.column(k).to_pylist() for k in range(7))):
                if (bucket, d) != key:
                    if held:
                        close()
                    key, held = (bucket, d), []
                held.append(tuple(row))
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _NODE_ARROW.types)], schema=_NODE_ARROW)
                out = []
        if held:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _NODE_ARROW.types)], schema=_NODE_ARROW)

    ordered = closed.select("bucket", "d", "rep", "cnt", "ends", "ids", "sizes").repartition("bucket", "d").sortWithinPartitions("bucket", "d")
    return ordered.mapInArrow(sort, _NODE)


# ---------------------------------------------------------------- the trie
def prefix_trie(conversations: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    convs = written(encoded(conversations), "conversations")
    seqs = written(sequences(rebuilt(convs)), "sequences")
    root = seqs.agg(F.min("rep").alias("rep"), F.sum("cnt").alias("cnt"), F.max(F.when(F.size("ids") == 0, F.col("ends"))).alias("ends")).first()
    if root.rep is None:
        return empty_like(spark, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    upper = [spark.createDataFrame([(root.rep, 0, None, root.cnt, root.ends, 0, [root.rep])], "conv_id long, depth long, parent_conv_id long, n_convs long, ends string, bytes long, path array<long>")]
    state = seqs.where("size(ids) > 0").select("*", F.lit(root.rep).alias("bucket"), F.lit(0).cast("long").alias("d"), F.array(F.lit(root.rep)).alias("path"))
    small, digit = [], 1
    while True:
        large = written(state.groupBy("bucket", "d").agg(F.sum(F.size("ids") - F.col("d")).alias("turns"), F.count("*").alias("n")).where(f"turns > {local_turns} and n > 1").select("bucket", "d"), "buckets")
        small.append(finished(state.join(large, ["bucket", "d"], "left_anti")))
        if large.isEmpty():
            break
        nodes, state = _dealt_out(state.join(large, ["bucket", "d"], "left_semi"), digit)
        upper.append(nodes)
        digit = min(2 * digit, MOST_DIGITS)
    below = small[0]
    for more in small[1:]:
        below = below.unionByName(more)
    below = written(below, "nodes")
    above = upper[0]
    for more in upper[1:]:
        above = above.unionByName(more)
    result = below.where("not top").drop("top").unionByName(_summed(above, below.where("top")))
    return result.withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY_SHA))).drop("ends")


def _dealt_out(part: DataFrame, digit: int) -> tuple[DataFrame, DataFrame]:
    """One round of buckets too large for a task: the nodes of the next ``digit`` depths, and the sequences that go on, in their new buckets."""
    prefixes = part.select("bucket", "d", "rep", "cnt", "ends", F.size("ids").alias("len"), "sizes", "ids", F.explode(F.expr(f"sequence(1, cast(least({digit}, size(ids) - d) as int))")).alias("j"))
    prefixes = prefixes.select("bucket", "d", "j", F.expr("slice(ids, cast(d as int) + 1, j)").alias("key"), "rep", "cnt", F.expr("if(len = d + j, ends, null)").alias("ends"), F.expr("sizes[cast(d as int) + j - 1]").alias("bytes"))
    stats = written(prefixes.groupBy("bucket", "d", "j", "key").agg(F.min("rep").alias("conv_id"), F.sum("cnt").alias("n_convs"), F.max("ends").alias("ends"), F.max("bytes").alias("bytes")), "prefixes")
    named = prefixes.select("bucket", "d", "j", "key", "rep").join(stats.select("bucket", "d", "j", "key", "conv_id"), ["bucket", "d", "j", "key"])
    along = named.groupBy("rep").agg(F.expr("transform(array_sort(collect_list(struct(j, conv_id))), x -> x.conv_id)").alias("convs"))
    moved = written(part.join(along, "rep").withColumn("path", F.concat("path", "convs")).drop("convs", "bucket"), "buckets")
    # the sequence of a node's least conversation has the path to it
    at = moved.select("rep", "d", "path", F.posexplode("path").alias("depth", "conv_id")).where("conv_id = rep and depth > d")
    nodes = at.select("conv_id", F.col("depth").cast("long"), F.expr("path[depth - 1]").alias("parent_conv_id"), F.expr("slice(path, 1, depth + 1)").alias("path"))
    known = stats.select("conv_id", F.expr("cast(d + j as long)").alias("depth"), "n_convs", "ends", "bytes")
    onward = moved.where(f"size(ids) > d + {digit}").withColumn("d", F.expr(f"cast(d + {digit} as long)")).withColumn("bucket", F.expr("element_at(path, -1)"))
    return nodes.join(known, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "ends", "bytes", "path"), onward


def _summed(above: DataFrame, tops: DataFrame) -> DataFrame:
    """The upper nodes with the sums of their subtrees: each node's own share goes to all nodes on its path."""
    children = above.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("upper_children"))
    lower = tops.select("conv_id", "depth", F.col("n_children").alias("lower_children"), F.col("n_leaves").alias("lower_leaves"), F.col("saved_tokens").alias("lower_saved"))
    all_ = above.join(children, ["conv_id", "depth"], "left").join(lower, ["conv_id", "depth"], "left")
    all_ = written(all_.withColumn("n_children", F.expr("coalesce(upper_children, 0) + coalesce(lower_children, 0)")).withColumn("leaves", F.expr("if(n_children = 0, 1, if(coalesce(lower_children, 0) > 0, lower_leaves, 0))")).withColumn("saved", F.expr("(n_convs - 1) * bytes + coalesce(lower_saved, 0)")), "upper")
    sums = all_.select(F.posexplode("path").alias("depth", "conv_id"), "leaves", "saved").groupBy("conv_id", F.col("depth").cast("long").alias("depth")).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return all_.join(sums, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
