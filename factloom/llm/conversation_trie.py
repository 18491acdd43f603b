"""The prefix tree of rebuilt conversations, by collapse of whole sequences.

Conversations are rebuilt first: the first turns of one conversation of a family before the own turns of
each. Equal rebuilt conversations become one weighted sequence with the list of those that end there;
sequences that are proper prefixes of others go by anti-join, which leaves the leaves; the prefixes of the
sequences are then aggregated with their weights.

No conversation has to fit into a task. Turns are sorted over range partitions, and what the parts of
a conversation before a partition add up to is one small row for each partition that begins inside a
conversation. A prefix is named by its length and 128 bits: the exclusive-or of a hash of each turn with its
place. Texts don't move: a turn is its SHA-256 and its bytes from the first shuffle on.

Sums over subtrees need no walk. The smallest member of a node owns it, and a sequence owns its nodes from one
depth on, so the distinct nodes below a node are, for each of its sequences, a stretch of that sequence's end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_batches

#: Conversations c - c % FAMILY to c share their first crc32(c) % HEADS turns.
FAMILY, HEADS = 5, 9
#: Ids of equal conversations that are joined into one row before they meet.
CHUNK = 1024
NODE = ["depth", "p1", "p2"]


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, str], extra: list[str]) -> DataFrame:
    """``key``, ``row`` (from 1) and the running values of ``sums`` (column to "sum" or "xor"), this row included, inside each ``key``; and ``extra``.

    Rows are sorted by ``key`` and ``order`` over range partitions; a key's rows may lie in any number of them.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    sums = {"row": "sum", **sums}
    names = list(sums)

    def run(batches):
        part, last, carried = TaskContext.get().partitionId(), None, [0] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]]))
            first = np.full(len(keys), -1)  # where each row's key began, -1: in an earlier batch
            first[starts] = starts
            first = np.maximum.accumulate(first)
            out = []
            for k, name in enumerate(names):
                values = batch.column(1 + k).to_numpy()
                step, back = (np.bitwise_xor, np.bitwise_xor) if sums[name] == "xor" else (np.add, np.subtract)
                upto = step.accumulate(values)
                made = np.where(first < 0, step(upto, np.int64(carried[k])), back(upto, back(upto, values)[first]))
                carried[k] = int(made[-1])
                out.append(pa.array(made))
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part)), batch.column(0), *out, *batch.columns[1 + len(names) :]], names=["part", key, *names, *extra])

    schema = ", ".join(["part bigint", f"{key} {fields[key]}", *(f"{n} bigint" for n in names), *(f"{n} {fields[n]}" for n in extra)])
    dealt = rows.withColumn("row", F.lit(1)).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    local = dealt.select(key, *(F.col(n).cast("bigint") for n in names), *extra).mapInArrow(run, schema).checkpoint()
    upto = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = {"sum": F.sum, "xor": F.bit_xor}
    # What stands before a partition that begins inside a key: no more rows than partitions, so it can be broadcast.
    ahead = (
        local.groupBy(key, "part").agg(*(F.max_by(n, "row").alias(n) for n in names))
        .select(key, "part", *(total[sums[n]](n).over(upto).alias(f"before_{n}") for n in names)).where("before_row is not null")
    )
    before = {n: F.coalesce(f"before_{n}", F.lit(0)) for n in names}
    whole = (F.col(n).bitwiseXOR(before[n]) if sums[n] == "xor" else F.col(n) + before[n] for n in names)
    return local.join(F.broadcast(ahead), [key, "part"], "left").select(key, *(c.alias(n) for n, c in zip(names, whole)), *extra)


def rebuilt(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The turns of the rebuilt conversations: c, pos (from 1), length, sign and bytes; a turnless one is a row at pos 0."""
    text, role = F.coalesce(text_col, F.lit("")), F.coalesce(role_col, F.lit(""))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("c"), F.col(turn_col).alias("turn"),
        F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256).alias("sign"), F.octet_length(text).cast("bigint").alias("bytes"),
    )
    own = running(turns, "c", ["turn", "sign"], {}, ["sign", "bytes"]).withColumnRenamed("row", "pos").checkpoint()
    sizes = own.groupBy("c").agg(F.max("pos").alias("n"))
    asked = sizes.select("c", "n", (F.col("c") - F.col("c") % FAMILY).alias("base"), (F.crc32(F.col("c").cast("string").cast("binary")) % HEADS).alias("h"))
    plans = (
        asked.join(sizes.select(F.col("c").alias("base"), F.col("n").alias("there")), "base", "left")
        .withColumn("m", F.least("h", F.coalesce("there", F.lit(0)))).withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .select("c", "base", "h", "m", "length").checkpoint()
    )
    kept = own.join(plans, "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "length", "sign", "bytes")
    # A family has a bounded number of conversations and the first HEADS - 1 turns.
    taken = (
        own.where(F.col("pos") < HEADS).withColumnsRenamed({"c": "base"}).join(plans, "base").where("pos <= h").select("c", "pos", "length", "sign", "bytes")
    )
    empty = plans.where("length = 0").select("c", F.lit(0).cast("bigint").alias("pos"), "length", F.lit("").alias("sign"), F.lit(0).cast("bigint").alias("bytes"))
    return kept.unionByName(taken).unionByName(empty)


def end_digests(whole: DataFrame) -> DataFrame:
    """The SHA-256 of the ascending ids of each sequence, as text joined by commas.

    A digest is sequential by nature, so it runs over the ids in one stream, but in constant memory and over rows that
    each hold up to CHUNK ids that were sorted and joined before.
    """

    def joined(batches):
        key, ids, low = None, [], None
        make = lambda: pa.RecordBatch.from_pydict({"depth": [key[0]], "p1": [key[1]], "p2": [key[2]], "low": [low], "ids": [",".join(map(str, ids))]})
        for batch in batches:
            for *now, c in zip(*(x.to_pylist() for x in batch.columns)):
                if now != key or len(ids) == CHUNK:
                    if ids:
                        yield make()
                    key, ids, low = now, [], c
                ids.append(c)
        if ids:
            yield make()

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for *now, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if now != key:
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=[*NODE, "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_pydict({"depth": [key[0]], "p1": [key[1]], "p2": [key[2]], "ends_sha256": [state.hexdigest()]})

    key = "depth bigint, p1 bigint, p2 bigint"
    chunks = whole.repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c").select(*NODE, "c").mapInArrow(joined, f"{key}, low bigint, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "low").mapInArrow(hashed, f"{key}, ends_sha256 string")


def sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weighted sequences, prefixes of one conversation of each, ends) of rebuilt turns."""
    hashes = [F.when(F.col("pos") > 0, F.xxhash64(F.lit(k), "pos", "sign")).otherwise(F.lit(0)).alias(f"p{k}") for k in (1, 2)]
    made = turns.select("c", "pos", "length", "bytes", F.col("bytes").alias("upto"), *hashes, *(h.alias(f"x{k}") for k, h in enumerate(hashes, 1)))
    scanned = running(made, "c", ["pos"], {"upto": "sum", "p1": "xor", "p2": "xor"}, ["pos", "length", "bytes", "x1", "x2"]).checkpoint()
    whole = scanned.where("pos = length").select("c", F.col("pos").alias("depth"), "p1", "p2", "upto")
    alike = whole.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("c").alias("c"), F.max("upto").alias("total")).checkpoint()
    steps = scanned.join(alike.select("c", F.col("depth").alias("deepest")), "c").where("pos > 0").select(
        "c", F.col("pos").alias("depth"), "p1", "p2", (F.col("upto") - F.col("bytes")).alias("before"),
        F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "deepest",
    )
    zero = F.lit(0).cast("bigint")
    roots = alike.select("c", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("before"), zero.alias("q1"), zero.alias("q2"), F.col("depth").alias("deepest"))
    return alike, steps.unionByName(roots).checkpoint(), end_digests(whole)


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per node of the tree: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes that a shared prefix saves, over the subtree) and ends_sha256.

    Turns are ordered by turn, null first; of equal turn numbers by a hash of role and text. Null roles and texts are
    empty; rows without a conversation id belong to none and are left out. Repeated rows are turns of their own. A table
    without conversations has no nodes, not even a root. Other columns are ignored.
    """
    small_batches(conversations.sparkSession)
    shared_dir(conversations.sparkSession)
    alike, prefixes, ends = sequences(rebuilt(conversations, conv_col, turn_col, role_col, text_col))
    proper = prefixes.where("depth < deepest").select(*NODE).distinct()
    leaves = alike.join(proper, NODE, "left_anti").select("c", F.lit(1).alias("leaf"))
    nodes = prefixes.groupBy(*NODE).agg(F.min("c").alias("owner"), F.min("before").alias("before"), F.min("q1").alias("q1"), F.min("q2").alias("q2")).checkpoint()
    # From which depth on a sequence owns its nodes, the bytes before, and who owns the node above.
    owned = nodes.groupBy("owner").agg(F.min(F.struct("depth", "before", "q1", "q2")).alias("top")).select("owner", "top.*").checkpoint()
    above = owned.where("depth > 0").select("owner", (F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    parents = above.join(nodes.select(*NODE, F.col("owner").alias("parent")), NODE).select("owner", "parent")
    known = (
        alike.select("c", "weight", "total", F.col("depth").alias("deepest")).join(leaves, "c", "left")
        .join(owned.select(F.col("owner").alias("c"), F.col("depth").alias("own"), F.col("before").alias("own_before")), "c", "left")
        .join(parents.withColumnRenamed("owner", "c"), "c", "left")
        .select("c", "weight", "total", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("own", F.col("deepest") + 1).alias("own"), F.coalesce("own_before", "total").alias("own_before"), "parent")
        .checkpoint()
    )
    shared = F.col("weight") * (F.col("total") - F.col("before")) - (F.col("total") - F.greatest("before", "own_before"))
    above_it = F.when(F.col("depth") > F.col("own"), F.col("c")).when(F.col("depth") == F.col("own"), F.col("parent"))
    made = prefixes.join(known, "c").groupBy(*NODE).agg(
        F.min("c").alias("conv_id"), F.max(above_it).alias("parent_conv_id"), F.sum("weight").alias("n_convs"),
        F.sum(F.when((F.col("deepest") > F.col("depth")) & (F.col("own") <= F.col("depth") + 1), 1).otherwise(0)).alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.sum(shared).alias("saved_tokens"),
    )
    none = hashlib.sha256().hexdigest()
    return made.join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )


def prefix_trie_sql() -> str:
    """DuckDB SQL for the rows of ``prefix_trie`` over ``conversations``; crc32 bit by bit, subtrees by the depths above each node."""
    crc = (
        "xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda a, b: "
        "list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(a, b)), 4294967295::BIGINT))"
    )
    return f"""
WITH turns AS (
  SELECT conv_id, sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS sign, strlen(coalesce(text, '')) AS bytes, turn
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, sign, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sign) AS pos FROM turns),
plans AS (SELECT conv_id AS c, {crc} % {HEADS} AS h, conv_id - conv_id % {FAMILY} AS base FROM (SELECT DISTINCT conv_id FROM own)),
parts AS (
  SELECT p.c, 0 AS part, o.pos, o.sign, o.bytes FROM plans p JOIN own o ON o.conv_id = p.base AND o.pos <= p.h
  UNION ALL SELECT p.c, 1, o.pos, o.sign, o.bytes FROM plans p JOIN own o ON o.conv_id = p.c AND o.pos > p.h),
seqs AS (SELECT c, sign, bytes, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth FROM parts),
steps AS (
  SELECT c, depth, bytes, sha256(string_agg(sign, ',') OVER (PARTITION BY c ORDER BY depth)) AS node FROM seqs
  UNION ALL SELECT c, 0, 0, '' FROM plans),
deep AS (SELECT c, max(depth) AS deepest FROM steps GROUP BY c),
nodes AS (SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM steps GROUP BY node, depth),
up AS (SELECT s.node, n.node AS above, n.depth = s.depth - 1 AS direct, n.conv_id
  FROM nodes s JOIN steps w ON w.c = s.conv_id AND w.depth <= s.depth JOIN nodes n ON n.node = w.node AND n.depth = w.depth),
below AS (SELECT u.above, sum((n.n_convs - 1) * n.bytes) AS saved, sum(CASE WHEN k.above IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM up u JOIN nodes n ON n.node = u.node LEFT JOIN (SELECT DISTINCT above FROM up WHERE direct) k ON k.above = u.node GROUP BY u.above),
children AS (SELECT above, count(*) AS n FROM up WHERE direct GROUP BY above),
ends AS (SELECT s.node, sha256(string_agg(s.c::VARCHAR, ',' ORDER BY s.c)) AS sha FROM steps s JOIN deep d ON d.c = s.c AND d.deepest = s.depth GROUP BY s.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.leaves::BIGINT AS n_leaves,
  b.saved::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes n JOIN below b ON b.above = n.node LEFT JOIN up p ON p.node = n.node AND p.direct LEFT JOIN children k ON k.above = n.node LEFT JOIN ends e ON e.node = n.node"""
