"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is turned by a fixed random rotation and its signs are its code x, a unit vector with
components of +-1/sqrt(D). Stored beside it is the correction factor c = <o, x>. For another unit vector q,
<q, x> / c is an unbiased estimate of <q, o> over rotations: the error is sqrt(1 - c^2) / c times the
product of q with a direction orthogonal to x, at most sqrt(1 - <q, o>^2) and of that size over sqrt(D - 1) as
a rule. So a linked pair's estimate is above ``threshold`` less a bound, and only pairs above it are computed
again, exactly and in double precision. ``confidence`` names the bound in those standard deviations;
None is the certain bound, which loses no pair.

Equal vectors are one class with a weight before anything is compared. Classes of a label are cut into blocks,
and a large label first into cells around pivots: a vector visits the cells that can hold a partner by the
triangle inequality of angles, so no linked pair is lost. A task keeps one block and streams visitors past it; it
sends out sums of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_type, shared_dir, small_batches
from .simhash import components

THRESHOLD = 0.98
#: Vectors that a task keeps in memory; larger cells are cut into blocks of about this size.
BLOCK = 2048
#: Blocks whose visitors share a copy of the residents; more blocks are dealt to more tasks.
SPREAD = 8
#: Pivots of a label at most, and labels that get pivots (the largest). They change speed only.
PIVOTS, PIVOT_LABELS = 256, 32
SEED = 20
#: Estimates made, and pairs computed again, by one numpy call.
GRID, EXACT = 1 << 20, 1 << 14
#: For the rounding of estimates in single precision.
SLACK = 1e-4


@functools.lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction factors of unit vectors."""
    turned = units @ rotation(units.shape[1])
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(units.shape[1])


def decode(codes: np.ndarray, dim: int) -> np.ndarray:
    """Packed codes as unit vectors in the turned space."""
    return np.where(np.unpackbits(codes, axis=1, count=dim), np.float32(1), np.float32(-1)) / np.float32(math.sqrt(dim))


def least_product(factors: np.ndarray, dim: int, threshold: float, confidence: float | None) -> np.ndarray:
    """What <q, x> is at least for a linked pair, by the code's correction factor."""
    share = 1.0 if confidence is None or dim < 2 else min(1.0, confidence / math.sqrt(dim - 1))
    spread = np.sqrt(np.maximum(0, 1 - factors**2)) * math.sqrt(max(0.0, 1 - threshold**2))
    return (threshold * factors - share * spread - SLACK).astype(np.float32)


class _Block:
    """The residents of one block: their links with each other and with visitors."""

    def __init__(self, dim: int, ids, weights, codes, factors, units, threshold: float, confidence: float | None):
        self.dim, self.ids, self.weights, self.units, self.threshold = dim, ids, weights, units, threshold
        self.codes, self.least = decode(codes, dim).T, least_product(factors, dim, threshold, confidence)
        self.links, self.root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))

    def hits(self, units: np.ndarray, start: int | None):
        """Linked (visitor, resident) places. ``start``: the visitors are residents from there on, each pair once."""
        turned = (units @ rotation(self.dim)).astype(np.float32)
        step = max(1, GRID // len(self.ids))
        for at in range(0, len(units), step):
            who, res = np.nonzero(turned[at : at + step] @ self.codes >= self.least)
            who += at
            if start is not None:
                who, res = who[later := res > who + start], res[later]
            for k in range(0, len(who), EXACT):
                w, r = who[k : k + EXACT], res[k : k + EXACT]
                near = np.einsum("ij,ij->i", units[w], self.units[r]) >= self.threshold
                if near.any():
                    yield w[near], r[near]

    def join(self, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Union of places a and b; each root is the smallest place of its set."""
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return root
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            while not np.array_equal(again := root[root], root):
                root = again

    def settle(self) -> None:
        """Links among the residents."""
        for w, r in self.hits(self.units, 0):
            np.add.at(self.links, w, self.weights[r])
            np.add.at(self.links, r, self.weights[w])
            self.root = self.join(w, r, self.root)

    def visit(self, ids, weights, units):
        """(id, resident, links) of each visitor with links; the residents' links are kept for the end."""
        m, links = len(self.ids), np.zeros(len(ids), dtype=np.int64)
        root = np.concatenate([self.root, np.arange(m, m + len(ids))])
        for w, r in self.hits(units, None):
            np.add.at(links, w, self.weights[r])
            np.add.at(self.links, r, weights[w])
            root = self.join(w + m, r, root)
        self.root = root[:m].copy()
        found = np.flatnonzero(links)
        return ids[found], self.ids[root[m:][found]], links[found]

    def close(self):
        found = np.flatnonzero(self.links)
        return self.ids[found], self.ids[self.root[found]], self.links[found]


def _arrays(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and lengths of a list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets[:-1], np.diff(offsets)


def usable(vector_col: str, label_col: str):
    """Rows that can link: a label, and a vector of finite numbers that are not all zero."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.col(label_col).isNotNull() & F.coalesce(sound, F.lit(False))


def _pivots(classes: DataFrame, block: int) -> dict:
    """(label, dimension) to unit vectors, at most PIVOTS x PIVOT_LABELS of them."""
    wide = (
        classes.groupBy("label", "dim").count().where(F.col("count") > 4 * block).orderBy(F.desc("count"), "label", "dim").limit(PIVOT_LABELS)
        .select("label", "dim", F.least(F.lit(PIVOTS), F.ceil(F.col("count") / (4 * block))).alias("wanted"))
    )
    first = Window.partitionBy("label", "dim").orderBy(F.xxhash64("vec"), "cls")
    chosen = (
        classes.select("label", "dim", "cls", "vec").join(F.broadcast(wide), ["label", "dim"])
        .withColumn("k", F.row_number().over(first)).where((F.col("k") <= PIVOTS) & (F.col("k") <= F.col("wanted")))
    )
    out: dict = {}
    for row in chosen.select("label", "dim", "vec", "k").orderBy("label", "dim", "k").collect():
        out.setdefault((row.label, row.dim), []).append(row.vec)
    return {k: unit(np.array(v)) for k, v in out.items()}


def codes(classes: DataFrame, pivots: dict, threshold: float) -> DataFrame:
    """Each class with its code, factor, home cell and the cells after it that can hold a partner."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    kind = classes.schema["vec"].dataType.elementType
    wire = np.float32 if isinstance(kind, T.FloatType) else np.float64
    label = classes.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, labels, dims, weights, vectors = batch.columns
            values, starts, lengths = _arrays(vectors)
            named, out = labels.to_pylist(), {}
            for place, key in enumerate(zip(named, lengths.tolist())):
                out.setdefault(key, []).append(place)
            for (name, dim), places in out.items():
                raw = values[starts[places][:, None] + np.arange(dim)].astype(wire)
                units = unit(raw)
                bits, factors = encode(units)
                home, visits = np.zeros(len(places), dtype=np.int32), [[]] * len(places)
                near = shared.value.get((name, dim))
                if near is not None:
                    angles = np.arccos(np.clip(units @ near.T, -1, 1))
                    home = angles.argmin(axis=1).astype(np.int32)
                    open_ = (angles <= angles.min(axis=1, keepdims=True) + 2 * reach) & (np.arange(len(near)) > home[:, None])
                    visits = [np.flatnonzero(x).tolist() for x in open_]
                take = pa.array(places)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take), labels.take(take), dims.take(take), weights.take(take), pa.array(home), pa.array(visits, type=pa.list_(pa.int32())),
                        pa.array([x.tobytes() for x in bits], type=pa.binary()), pa.array(factors), pa.array([x.tobytes() for x in raw], type=pa.binary()),
                    ],
                    names=["cls", "label", "dim", "weight", "home", "visits", "code", "factor", "vec"],
                )

    return classes.select("cls", "label", "dim", "weight", "vec").mapInArrow(
        run, f"cls bigint, label {label}, dim int, weight bigint, home int, visits array<int>, code binary, factor double, vec binary"
    )


def links(coded: DataFrame, wire: type, threshold: float, block: int, confidence: float | None) -> DataFrame:
    """(cls, other, n): n links of ``cls`` found in one task, one of them, or a relative of one, being ``other``."""
    cells = (
        coded.groupBy("label", "dim", "home").count()
        .select("label", "dim", F.col("home").alias("cell"), F.ceil(F.col("count") / block).cast("int").alias("blocks"), F.monotonically_increasing_id().alias("tile"))
        .withColumn("groups", F.ceil(F.col("blocks") / SPREAD).cast("int")).checkpoint()
    )
    carried = ["dim", "cls", "weight", "code", "factor", "vec"]
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    group = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("groups")).cast("int")
    at_home = coded.withColumn("cell", F.col("home")).join(cells, ["label", "dim", "cell"])
    steps = lambda low, high: F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")))
    residents = at_home.select("tile", own.alias("part"), steps(F.lit(0), F.col("groups") - 1).alias("grp"), F.lit(0).alias("kind"), *carried)
    same = at_home.select("tile", steps(own + 1, F.col("blocks") - 1).alias("part"), group.alias("grp"), F.lit(1).alias("kind"), *carried)
    abroad = (
        coded.withColumn("cell", F.explode("visits")).join(cells, ["label", "dim", "cell"])
        .select("tile", steps(F.lit(0), F.col("blocks") - 1).alias("part"), group.alias("grp"), F.lit(1).alias("kind"), *carried)
    )

    def run(batches):
        key, held, state = None, [], None

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in found], names=["cls", "other", "n"])

        def opened():
            """The block of what is held; links among residents belong to the first group."""
            made = _Block(held[0][0], *(np.concatenate([h[k] for h in held]) for k in range(1, 6)), threshold, confidence)
            if key[2] == 0:
                made.settle()
            return made

        def rows(part):
            dim = part.column(4)[0].as_py()
            raw = np.frombuffer(b"".join(part.column(9).to_pylist()), dtype=wire).reshape(-1, dim)
            bits = np.frombuffer(b"".join(part.column(7).to_pylist()), dtype=np.uint8).reshape(len(raw), -1)
            return dim, part.column(5).to_numpy(), part.column(6).to_numpy(), bits, part.column(8).to_numpy(), unit(raw)

        for batch in batches:
            if not batch.num_rows:
                continue
            tiles, parts, groups, kinds = (batch.column(k).to_numpy() for k in range(4))
            edges = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(parts) != 0) | (np.diff(groups) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(tiles)], strict=True):
                now = (int(tiles[lo]), int(parts[lo]), int(groups[lo]))
                if now != key:
                    if held:
                        state = state or opened()
                        yield out(state.close())
                    key, held, state = now, [], None
                dim, ids, weights, bits, factors, units = rows(batch.slice(lo, hi - lo))
                if kinds[lo] == 0:
                    held.append((dim, ids, weights, bits, factors, units))
                elif held:
                    state = state or opened()
                    yield out(state.visit(ids, weights, units))
        if held:
            yield out((state or opened()).close())

    dealt = residents.unionByName(same).unionByName(abroad).repartition("tile", "part", "grp").sortWithinPartitions("tile", "part", "grp", "kind")
    return dealt.mapInArrow(run, "cls bigint, other bigint, n bigint")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
    block: int = BLOCK, confidence: float | None = None,
) -> DataFrame:
    """One row per input row: ``id_col``, ``n_links`` (other rows of the same label whose cosine is ``threshold``
    or more), ``component_id`` (the smallest id reachable over links, itself included) and ``kept``.

    Rows link with nothing if the label or the vector is null, or the vector is empty, all zero, or holds a null or
    non-finite number; vectors of unlike lengths don't link. Repeated rows and ids are rows of their own and link
    with each other. A null id keeps its row and becomes no component_id unless all ids of its component are
    null; it is kept only then. An empty table gives an empty result; other columns are ignored. ``threshold`` is above 0.
    """
    small_batches(vectors.sparkSession)
    shared_dir(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"), F.col(label_col).alias("label"))
    classes = (
        rows.where(usable("vec", "label")).groupBy("label", "vec").agg(F.min("id").alias("low"), F.count("*").alias("weight"))
        .select(F.monotonically_increasing_id().alias("cls"), "label", F.size("vec").alias("dim"), "vec", "low", "weight").checkpoint()
    )
    wire = np.float32 if isinstance(classes.schema["vec"].dataType.elementType, T.FloatType) else np.float64
    found = links(codes(classes, _pivots(classes, block), threshold).checkpoint(), wire, threshold, block, confidence).checkpoint()
    degrees = found.groupBy("cls").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("other").alias("b")))
    linked = roots.select(F.col("node").alias("cls"), "root").unionByName(roots.select("root").distinct().select(F.col("root").alias("cls"), "root"))
    lows = linked.join(classes.select("cls", "low"), "cls").groupBy("root").agg(F.min("low").alias("first")).checkpoint()
    named = (
        classes.join(degrees, "cls", "left").join(linked.join(lows, "root").select("cls", "first", F.lit(True).alias("linked")), "cls", "left")
        .select("label", "vec", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.when(F.col("linked"), F.col("first")).otherwise(F.col("low")).alias("component"), F.lit(True).alias("named"))
        .checkpoint()
    )
    component = F.when(F.col("named"), F.col("component")).otherwise(F.col("id"))
    return rows.join(named, ["label", "vec"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def deduplicated(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """``vectors`` with the rows that ``near_duplicates`` keeps, all columns; of rows that repeat an id one stays, null ids stay."""
    keep = near_duplicates(vectors, id_col, **options).where("kept").select(id_col).distinct()
    return vectors.join(keep, id_col, "left_semi").dropDuplicates([id_col]).unionByName(vectors.where(F.col(id_col).isNull()))


def near_duplicates_sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the rows of ``near_duplicates`` over ``embeddings``: every pair of a label, for small tables."""
    return f"""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {threshold}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, r.low AS component_id, e.vec_id = r.low AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) n ON n.a = e.vec_id"""
