"""Field and class reports, gates, roll-ups, leakage between splits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import casefold, nfkc
from ..sources.strict import ensure_checkpoint_dir

#: Ids of a class of equal texts that are ordered in one task.
SLICE = 1024


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, and ``empty`` where b is 0 (0.0 in reports, null in the gold score)."""
    return F.when(b == 0, F.lit(empty).cast("double")).otherwise(a / b)


def _scores(tp: Column, fp: Column, fn: Column, empty: float | None = 0.0) -> list[Column]:
    precision, recall = ratio(tp, tp + fp, empty), ratio(tp, tp + fn, empty)
    return [precision.alias("precision"), recall.alias("recall"), ratio(2 * tp, 2 * tp + fp + fn, empty).alias("f1")]


def field_report(gold: DataFrame, predicted: DataFrame, key: list[str], field: str, value: str) -> DataFrame:
    """Per field tp, fp, fn, support, precision, recall, f1. A wrong value is a false positive
    and a false negative; null means no statement."""
    both = gold.select(*key, field, F.col(value).alias("_gold")).join(predicted.select(*key, field, F.col(value).alias("_pred")), [*key, field], "full_outer")
    right = F.col("_gold") == F.col("_pred")
    counts = both.groupBy(field).agg(
        F.count_if(right).alias("tp"), F.count_if(F.col("_pred").isNotNull() & ~F.coalesce(right, F.lit(False))).alias("fp"),
        F.count_if(F.col("_gold").isNotNull() & ~F.coalesce(right, F.lit(False))).alias("fn"), F.count_if(F.col("_gold").isNotNull()).alias("support"),
    )
    return counts.select("*", *_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def class_report(pairs: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One-vs-rest report over the labels that gold or predictions have."""
    sides = F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))
    same = (F.col(gold) == F.col(predicted)).cast("int")
    long = pairs.select(same.alias("same"), F.explode(sides).alias("s")).where("s.label IS NOT NULL")
    counts = long.groupBy(F.col("s.label").alias("label")).agg(
        F.sum(F.col("same") * F.col("s.g")).alias("tp"),
        F.sum((1 - F.coalesce("same", F.lit(0))) * F.col("s.p")).alias("fp"), F.sum((1 - F.coalesce("same", F.lit(0))) * F.col("s.g")).alias("fn"),
    )
    counts = counts.withColumn("tp", F.coalesce("tp", F.lit(0)))
    return counts.select("*", (F.col("tp") + F.col("fn")).alias("support"), *_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def gate(value: Column, support: Column, threshold: float, least: int) -> Column:
    """insufficient_data under the least support, else pass or fail."""
    return F.when(support < least, "insufficient_data").when(value >= threshold, "pass").otherwise("fail")


def worst_gate(status: Column) -> Column:
    """fail before insufficient_data before pass, as an aggregate."""
    rank = F.when(status == "fail", 0).when(status == "insufficient_data", 1).otherwise(2)
    return F.min_by(status, rank)


def uncovered(required: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """Keys missing from or unknown to a set that has to be covered exactly: (key, problem)."""
    missing = required.select(*key).distinct().join(present, key, "left_anti").withColumn("problem", F.lit("missing"))
    unknown = present.select(*key).distinct().join(required, key, "left_anti").withColumn("problem", F.lit("unknown"))
    return missing.unionByName(unknown)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def tokens(text: Column, exact: bool = False) -> Column:
    """Distinct lower-case words, as sorted 64-bit hashes. ``exact`` adds NFKC and full case folding, at the price of a Python stage."""
    given = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(casefold(nfkc(given)) if exact else F.lower(given), F.lit(r"(?U)(\w+)"), 1)
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


#: Tokens whose numbers of sets are known to every task (16 bytes each); all others are rarer than these.
FREQUENT = 200_000


def token_sets(df: DataFrame, id_col: str, text_col: str, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, set, key) of each row, and (rep, key), the smallest id of each class of equal sets.

    Both are written once in the checkpoint folder, so texts are read once. ``key`` is a 128-bit hash of the set.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sets = df.select(F.col(id_col).alias("id"), tokens(F.col(text_col), exact).alias("set"))
    key = F.concat(F.hex(F.xxhash64("set")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "set")))
    sets = sets.withColumn("key", key).checkpoint()
    return sets, sets.groupBy("key").agg(F.min("id").alias("rep")).checkpoint()


def jaccard_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float, exact: bool = False) -> DataFrame:
    """(left_id, right_id, score) of all pairs whose token sets have a Jaccard similarity of at
    least ``threshold``; two empty texts score 1.

    Equal token sets are one representative before any pairing; representatives meet on the
    rare tokens of their prefix (rarest first), so a common token pairs nothing by itself.
    Copies come back by membership: pairs are between representatives, plus one pair from each
    copy to its representative (the smallest id).
    """
    sets, reps = token_sets(df, id_col, text_col, exact)
    copies = sets.select("id", "key").join(reps, "key").where("id <> rep").select(F.col("rep").alias("left_id"), F.col("id").alias("right_id"), F.lit(1.0).alias("score"))
    return linked(sets, reps, threshold).unionByName(copies)


#: Longs of the sketch that goes with each token of a prefix, and of the one that goes with a pair; copies that are known to every task (more are taken out by a shuffle join).
SKETCH, WIDE, COPIES = 4, 32, 400_000
#: Pairs that are known to every task (16 bytes each), so that the sets of their left sides needn't be shuffled.
PAIRS = 1_000_000


def _sketches(flat: np.ndarray, row: np.ndarray, rows: int, longs: int) -> np.ndarray:
    """A sketch of each row's tokens: each token turns over one bit, so two sketches differ in no more bits than the sets in tokens."""
    bits = longs * 64
    odd = np.bincount(row * bits + flat % bits, minlength=rows * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, bits), axis=1).view(np.int64)


def _flat(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, row of each, length of each row) of a list column."""
    ends = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ends)), ends), ends


def _wide(sets: DataFrame) -> DataFrame:
    """(rep, n, w): of each set (rep, set) its size and its wide sketch as an array."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat, row, ends = _flat(part.column(1))
                sketch = _sketches(flat, row, len(ends), WIDE)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(ends) + 1) * WIDE, WIDE, dtype=np.int32)), pa.array(sketch.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ends.astype(np.int32)), lists], names=["rep", "n", "w"])

    return sets.mapInArrow(run, T.StructType([sets.schema["rep"]]).add("n", "integer").add("w", T.ArrayType(T.LongType())))


def _prefixes(sets: DataFrame, counts: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """(rep, n, token, s0, s1, ...): of each set (rep, set) its n - ceil(threshold * n) + 1 rarest tokens; any partner shares one.

    The s are a sketch of the set.
    """
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    schema = T.StructType([sets.schema["rep"], T.StructField("n", T.IntegerType()), T.StructField("token", T.LongType()), *(T.StructField(f"s{k}", T.LongType()) for k in range(SKETCH))])

    def run(batches):
        known, numbers = shared.value
        for batch in batches:
            flat, row, ends = _flat(batch.column(1))
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            number = np.where(known[at] == flat, numbers[at], 0) if len(known) else np.zeros(len(flat), np.int64)
            order = np.lexsort((flat, number, row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)
            width = ends - np.ceil(threshold * ends - 1e-9).astype(np.int64) + 1
            kept = order[place < np.repeat(width, ends)]
            sketch = _sketches(flat, row, len(ends), SKETCH)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[kept])), pa.array(ends[row[kept]].astype(np.int32)), pa.array(flat[kept]), *(pa.array(sketch[row[kept], k]) for k in range(SKETCH))], names=[f.name for f in schema]
            )

    return sets.mapInArrow(run, schema)


def linked(sets: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, score) of all pairs of representatives of token_sets(), left before right.

    Representatives that share a token of their prefixes are compared by their sketches first: in a pair of the
    threshold the sets differ in at most (1 - threshold) / (1 + threshold) of their tokens. Pairs that pass are compared by wider
    sketches, and only for those that pass again are whole sets joined.
    """
    copies = sets.select("id", "key").join(reps.withColumnRenamed("rep", "id"), ["id", "key"], "left_anti").distinct().checkpoint()
    copies = F.broadcast(copies) if copies.count() <= COPIES else copies
    own = sets.where((F.size("set") > 0) & F.col("id").isNotNull()).join(copies, ["id", "key"], "left_anti").select(F.col("id").alias("rep"), "set")
    often = own.select(F.explode("set").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas().sort_values("token")
    prefix = _prefixes(own, (often["token"].to_numpy(np.int64), often["n"].to_numpy(np.int64)), threshold)
    left, right = prefix.alias("l"), prefix.alias("r")
    differ = sum((F.bit_count(F.col(f"l.s{k}").bitwiseXOR(F.col(f"r.s{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col("l.s0").bitwiseXOR(F.col("r.s0"))))
    most = F.lit((1 - threshold) / (1 + threshold))
    near = (F.least("l.n", "r.n") >= F.lit(threshold) * F.greatest("l.n", "r.n")) & (differ <= (F.col("l.n") + F.col("r.n")) * most + 1e-6)
    candidates = left.join(right, (F.col("l.token") == F.col("r.token")) & (F.col("l.rep") < F.col("r.rep")) & near).select(F.col("l.rep").alias("left_id"), F.col("r.rep").alias("right_id")).distinct()
    wide = _wide(own)
    u, v = (wide.select(F.col("rep").alias(f"{x}_id"), F.col("n").alias(f"{x}_n"), F.col("w").alias(f"{x}_w")) for x in ("left", "right"))
    turned = F.aggregate(F.zip_with("left_w", "right_w", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    candidates = candidates.join(u, "left_id").join(v, "right_id").where(turned <= (F.col("left_n") + F.col("right_n")) * most + 1e-6).select("left_id", "right_id").distinct().checkpoint()
    a, b = own.select(F.col("rep").alias("left_id"), F.col("set").alias("_a")), own.select(F.col("rep").alias("right_id"), F.col("set").alias("_b"))
    known = F.broadcast(candidates) if candidates.count() <= PAIRS else candidates
    both = a.join(known, "left_id").join(b, "right_id").withColumn("_common", F.size(F.array_intersect("_a", "_b")))
    score = F.col("_common") / (F.size("_a") + F.size("_b") - F.col("_common"))
    # An id may stand in the table more than once.
    return both.select("left_id", "right_id", score.alias("score")).where(F.col("score") >= threshold).distinct()


def _ordered(rows: DataFrame, part: list[str], order: str, splits: list) -> DataFrame:
    """(split_a, split_b, n) of the pairs of a left and a right member whose first one comes strictly earlier.

    ``rows`` have l, r, split and the numbers of left and right members nl and nr; where l and r
    are one class, each member is both and a pair counts once.
    """
    before = Window.partitionBy(*part).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)

    def earlier(side: str, s) -> Column:
        return F.coalesce(F.sum(F.when(F.col("split") == s, F.col(side))).over(before), F.lit(0))

    n = [F.col("nr") * earlier("nl", s) + F.when(F.col("l") == F.col("r"), 0).otherwise(F.col("nl") * earlier("nr", s)) for s in splits]
    long = rows.select("split", *(x.alias(f"_{k}") for k, x in enumerate(n)))
    pairs = F.array(*(F.struct(F.lit(s).alias("split_a"), F.col(f"_{k}").alias("n")) for k, s in enumerate(splits)))
    return long.select(F.explode(pairs).alias("p"), F.col("split").alias("split_b")).where("p.n > 0 AND p.split_a <> split_b").select("p.split_a", "split_b", "p.n")


def leakage(df: DataFrame, id_col: str, text_col: str, threshold: float, split: Callable[[Column], Column], splits: list) -> DataFrame:
    """(split_a, split_b, n): all pairs of rows of different splits whose token sets have a Jaccard
    similarity of at least ``threshold``; split_a is the split of the smaller id.

    ``split`` gives the split of an integer id, one of ``splits``. Pairs of copies aren't expanded:
    members are counted by class of equal token sets, slice of ids and split. Products of these
    counts give the pairs across slices; only ids of one slice are ordered one by one.
    """
    slot = F.floor(F.col("id") / SLICE).cast("bigint")
    sets, named = token_sets(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), "id", "text")
    members = sets.select("id", "key", slot.alias("slot"), split(F.col("id")).alias("split"))
    counts = members.groupBy("key", "slot", "split").agg(F.count("*").alias("n"))
    size = counts.groupBy("key").agg(F.sum("n").alias("size"))
    classes = named.join(size, "key")
    left, right = (classes.select(F.col("rep").alias(f"{x}_id"), F.col("key").alias(x[0]), F.col("size").alias(f"{x}_size")) for x in ("left", "right"))
    links = linked(sets, named, threshold).join(left, "left_id").join(right, "right_id").select("left_id", "right_id", "l", "r", (F.greatest("left_size", "right_size") > 1).alias("many")).persist()
    single = links.where("NOT many").select(split(F.col("left_id")).alias("split_a"), split(F.col("right_id")).alias("split_b"), F.lit(1).cast("bigint").alias("n")).where("split_a <> split_b")
    many = links.where("many").select("l", "r").unionByName(size.where("size > 1").select(F.col("key").alias("l"), F.col("key").alias("r")))

    def sides(pairs: DataFrame, rows: DataFrame, *also: str) -> DataFrame:
        """Each pair of classes with the rows of both; a class with itself has its rows once."""
        n, none, own = F.col("n"), F.lit(0).cast("bigint"), F.col("l") == F.col("r")
        a = pairs.join(rows.withColumnRenamed("key", "l"), ["l", *also]).withColumns({"nl": n, "nr": F.when(own, n).otherwise(none)})
        b = pairs.where(~own).join(rows.withColumnRenamed("key", "r"), ["r", *also]).withColumns({"nl": none, "nr": n})
        return a.unionByName(b)

    across = sides(many, counts)
    met = across.groupBy("l", "r", "slot").agg(F.sum("nl").alias("a"), F.sum("nr").alias("b"), F.min("split").alias("s"), F.max("split").alias("t")).where("a > 0 AND b > 0 AND s <> t")
    within = sides(met.select("l", "r", "slot"), members.withColumn("n", F.lit(1).cast("bigint")), "slot")
    found = single.unionByName(_ordered(across, ["l", "r"], "slot", splits)).unionByName(_ordered(within, ["l", "r", "slot"], "id", splits))
    return found.groupBy("split_a", "split_b").agg(F.sum("n").alias("n"))
