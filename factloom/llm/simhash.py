"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints are put into tiles by the population counts of their four 16-bit
quarters. Two fingerprints whose counts differ by more than the radius in sum
differ in more bits than the radius, so only tile pairs within that distance
are ever brought together; inside them numpy compares everything exactly. A
task keeps a union-find over a bounded block of a tile's residents and streams
the visitors past it, so it emits a spanning forest and never all pairs.
"""

from __future__ import annotations

from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_batches, shared_dir

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints of a tile held in a task's memory at once; larger tiles are split.
BLOCK = 8192
#: Comparisons made by one numpy call.
GRID = 1 << 18
_UNPACK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a whole text; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n <= 1:
        made, n = [b" ".join(words)], 1
    else:
        made = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, made, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _UNPACK):
        part = hashes[at : at + _UNPACK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint's bits as a signed long), one row per input row.

    Null and blank texts have fingerprint 0.
    """

    def make():
        def work(ids, texts):
            fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
            return ids, pa.array(fps.view(np.int64))

        return work

    return map_batches(docs, [id_col, text_col], make, f"`{id_col}` {id_type(docs, id_col)}, fp bigint")


def _offsets(radius: int) -> list[int]:
    """Codes of the tile offsets within the radius, one of each opposite pair."""
    steps = [o for o in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, o)) <= radius]
    half = [o for o in steps if o >= (0, 0, 0, 0)]
    return [((a * 32 + b) * 32 + c) * 32 + d for a, b, c, d in half]


class _Tile:
    """Union-find over one block of residents; visitors stream past."""

    def __init__(self, radius: int):
        self.radius, self.members = np.uint8(radius), np.empty(0, dtype=np.uint64)
        self.root = np.empty(0, dtype=np.int64)

    def add(self, fps: np.ndarray) -> None:
        self.members = np.concatenate([self.members, fps])
        self.root = np.arange(len(self.members))

    def _flatten(self) -> None:
        while not np.array_equal(again := self.root[self.root], self.root):
            self.root = again

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            i = int(self.root[i])
        return i

    def compare(self, fps: np.ndarray) -> tuple[list[int], list[int]]:
        """Links of the visitors: one (visitor, resident) pair for each linked visitor."""
        left: list[int] = []
        right: list[int] = []
        n = len(self.members)
        if not n:
            return left, right
        step = max(1, GRID // n)
        for at in range(0, len(fps), step):
            part = fps[at : at + step]
            hits = np.flatnonzero(np.bitwise_count(part[:, None] ^ self.members[None, :]) <= self.radius)
            who, res = hits // n, hits % n
            other = part[who] != self.members[res]
            who, res = who[other], res[other]
            if not len(who):
                continue
            pairs = np.unique(who * n + self.root[res])
            first: dict[int, int] = {}
            for pair in pairs.tolist():
                w, r = divmod(pair, n)
                r = self._find(r)
                seen = first.get(w)
                if seen is None:
                    first[w] = r
                    left.append(int(part[w]))
                    right.append(int(self.members[r]))
                elif (seen := self._find(seen)) != r:
                    self.root[max(seen, r)] = min(seen, r)
            self._flatten()
        return left, right

    def close(self) -> tuple[list[int], list[int]]:
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.members[moved].tolist(), self.members[self.root[moved]].tolist()


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """A spanning forest (a, b) of the graph that links fingerprints ``fp`` (distinct
    values) at ``radius`` or fewer differing bits. Radius up to 3; every linked pair is
    found, and pairs already joined inside a task aren't repeated."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int") + radius for k in range(4)]
    tile = ((quarter[0] * 32 + quarter[1]) * 32 + quarter[2]) * 32 + quarter[3]
    tiled = distinct.select("fp", tile.alias("home"))
    # At most 17^4 rows whatever the input is, so it can be broadcast.
    homes = F.broadcast(
        tiled.groupBy("home").count().select(F.col("home").alias("tile"), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    )
    residents = tiled.withColumnRenamed("home", "tile").join(homes, "tile").select(
        "tile", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("part"), F.lit(0).alias("kind"), "fp"
    )
    visitors = (
        tiled.select("fp", F.explode(F.lit(_offsets(radius))).alias("o"), "home").select("fp", (F.col("home") + F.col("o")).alias("tile"))
        .join(homes, "tile")
        .select("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(1).alias("kind"), "fp")
    )

    def run(batches):
        key, state = None, None

        def out(pairs):
            a, b = (np.array(x, dtype=np.uint64).view(np.int64) for x in pairs)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tiles, parts, kinds, fps = (batch.column(i).to_numpy() for i in range(4))
            fps = fps.view(np.uint64)
            change = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(tiles)], strict=True):
                if (now := (int(tiles[lo]), int(parts[lo]))) != key:
                    if state is not None:
                        yield out(state.close())
                    key, state = now, _Tile(radius)
                if kinds[lo] == 0:
                    state.add(fps[lo:hi])
                elif len((found := state.compare(fps[lo:hi]))[0]):
                    yield out(found)
        if state is not None:
            yield out(state.close())

    return (
        residents.unionByName(visitors).repartition("tile", "part").sortWithinPartitions("tile", "part", "kind")
        .mapInArrow(run, "a bigint, b bigint")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (node, root), root the smallest node.

    Alternates two star contractions, each an aggregate and a join, and stops when the
    edges no longer change. Every round is checkpointed in the shared folder, so a lost
    executor costs one round. The smallest neighbours are written before each join, so that the side
    of a node with very many edges can be split. Nodes without edges don't appear.
    """
    shared_dir(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).checkpoint()
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct().checkpoint()
        low = large.groupBy("a").agg(F.min("b").alias("m")).checkpoint()
        small = (
            large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        after = small.checkpoint()
        changed = after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty()
        now = after
        if changed:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, block: int = BLOCK
) -> DataFrame:
    """One row per input row: ``id_col``, ``fingerprint`` (16 lowercase hex digits) and
    ``component_id`` (the smallest id reachable over links, itself included).

    Null and blank texts share fingerprint zero and link like any other; repeated ids and
    texts keep their rows; a null id keeps its row and never becomes a component_id unless
    its whole component has null ids. An empty table gives an empty result.
    """
    shared_dir(docs.sparkSession)
    fps = fingerprints(docs, id_col, text_col, shingle).checkpoint()
    distinct = fps.groupBy("fp").agg(F.min(id_col).alias("low"))
    roots = components(links(distinct.select("fp"), radius, block))
    linked = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select("root").distinct().select(F.col("root").alias("fp"), "root"))
    # One row per group of linked fingerprints. Written, so that a very large group's side of the next join can be split.
    lows = linked.join(distinct, "fp").groupBy("root").agg(F.min("low").alias("component_id")).checkpoint()
    moved = linked.join(lows, "root").select("fp", "component_id")
    # Fingerprints without a link have their own smallest id.
    names = distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")).checkpoint()
    # Both sides are plain exchanges now, so a fingerprint that very many rows share is split by the skew join.
    return fps.join(names, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest id; all columns stay.

    Of rows that repeat an id one stays. Rows with a null id are kept: nothing names them.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    keep = found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    return docs.join(keep, id_col, "left_semi").dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))
