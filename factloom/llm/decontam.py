"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Fixed masks select some of a window's tokens and ignore the others, so a substituted word under
a hole leaves the window's hash unchanged. The benchmark's windows are a hash table of bounded
size in every task; training texts are cut into slices of so many tokens, and a slice's windows
are made, looked up and laid on the item's tokens one after another, so memory is bounded
whatever a text repeats. A seed that very many items share, as exam questions with one opening do, is not laid on
each of them: the tokens about a hit are looked up by parts, one of which is equal if they are alike enough. Neither windows nor texts are shuffled; only overlaps leave the task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: Windows of tokens; 1 is hashed, 0 is ignored.
MASKS = ("1101011", "11100101")
#: Items of fewer tokens have no masked window; they are found as a whole.
SHORTEST = min(map(len, MASKS))
#: Tokens compared around a hit, and the share of them that has to be equal.
AROUND, SIMILARITY = 20, 0.8
#: Windows made of one slice of a text's tokens.
SLICE = 256
#: Stands for the windows that would go beyond the text's end; no item has it.
NO_SEED = 0
#: Seeds of one broadcast (at most 300 bytes each); a larger benchmark is searched in so many passes.
BLOCK_SEEDS = 200_000
BROADCAST_IDS = 1_000_000
#: Classes of compared tokens that one seed leads to directly; those of a seed with more are found by parts of the tokens.
HOT_CLASSES = 32
#: Words are what stands between white space and punctuation, lower-cased.
SEPARATORS = r"[\s\p{Punct}\p{P}\p{Z}]+"
#: In scripts written without spaces (Thai, Lao, Burmese, Khmer, Han and kana) every character is a word.
UNSPACED = r"[฀-໿က-႟ក-៿⺀-鿿豈-﫿\x{20000}-\x{3FFFF}]"


def token_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words; null text: no words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.when(F.rlike(low, F.lit(UNSPACED)), F.regexp_replace(low, UNSPACED, " $0 ")).otherwise(low)
    return F.transform(F.array_remove(F.split(low, SEPARATORS), ""), lambda w: F.xxhash64(w))


def _kinds(lengths: list[int]) -> list[tuple[int, list[int], int]]:
    """(number, hashed places, tokens of a window) of each mask, and of whole items of these lengths."""
    masks = [(k, [j for j, c in enumerate(m) if c == "1"], len(m)) for k, m in enumerate(MASKS)]
    return masks + [(len(MASKS) + n, list(range(n)), n) for n in lengths]


def _windows(tokens: DataFrame, lengths: list[int], begin: Column, count: Column) -> DataFrame:
    """``tokens`` (a table with the array _tokens) with one row per window: at, seed, number.

    There are windows of each kind at ``count`` places from ``begin`` on. They are numbered by one
    generated sequence, so the array is only referred to; the outer explode keeps the optimizer
    from counting the tokens once more in a filter.
    """
    kinds, t = _kinds(lengths), F.col("_tokens")
    n = F.size(t)
    numbers = F.when(count > 0, F.sequence(F.lit(0), count * len(kinds) - 1))
    rows = tokens.select("*", F.explode_outer(numbers).alias("_k"))
    at, number, seed = (F.col("_k") / len(kinds)).cast("int") + begin, F.col("_k") % len(kinds), F.lit(NO_SEED).cast("bigint")
    for k, (mark, offsets, width) in enumerate(kinds):
        fits = (number == k) & (F.col("at") + width <= n)
        seed = F.when(fits, F.xxhash64(F.lit(mark), *(F.get(t, F.col("at") + o) for o in offsets))).otherwise(seed)
    return rows.withColumn("at", at).withColumn("seed", seed).withColumn("number", number)


def seeds(items: DataFrame, item_id: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """(seed, item_id, offset, near) of the benchmark's windows, and the lengths of the items shorter than the masks.

    ``near`` are the at most AROUND tokens to be compared, ``offset`` the window's place in them.
    Windows alike in all of this are one row, so a text of one word repeated has a few rows only.
    """
    own = items.select(F.col(item_id).alias("item_id"), token_hashes(F.col(text_col)).alias("_tokens"))
    short = own.select(F.size("_tokens").alias("n")).where((F.col("n") > 0) & (F.col("n") < SHORTEST)).distinct()
    lengths = sorted(r.n for r in short.collect())  # at most SHORTEST - 1 numbers
    n = F.size("_tokens")
    first = F.greatest(F.lit(0), F.least(F.col("at") - 6, n - AROUND))
    of_item = F.lit(False)
    for k, (mark, _, width) in enumerate(_kinds(lengths)):
        of_item = of_item | ((F.col("number") == k) & (F.col("at") + width <= n if mark < len(MASKS) else (n == width) & (F.col("at") == 0)))
    made = _windows(own, lengths, F.lit(0), n).where(of_item)
    return made.select("seed", "item_id", (F.col("at") - first).alias("offset"), F.slice("_tokens", first + 1, AROUND).alias("near")).distinct(), lengths


def _parts(near: Column, size: Column, similarity: float, token) -> Column:
    """Hashes of the parts of ``size`` compared tokens, place p in part p modulo their number; ``token`` gives the token at a place.

    There is one part more than tokens that may differ, so two token lists that are alike enough have an equal part. Places
    of a part lie far from each other: lists that begin or end alike have few equal parts. A part with a missing token is null.
    """
    parts = size - F.ceil(similarity * size - F.lit(1e-9)).cast("int") + 1

    def one(g):
        own = F.transform(F.filter(F.sequence(F.lit(0), size - 1), lambda p: p % parts == g), token)
        return F.when(~F.exists(own, lambda x: x.isNull()), F.xxhash64(near, size, g, own))

    return F.transform(F.sequence(F.lit(0), parts - 1), one)


def _tables(found: DataFrame, similarity: float, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a window's seed leads to, what a part of the compared tokens leads to, and the items of each class.

    Seeds with the same place and the same compared tokens are one class, whatever number of items has it. A seed
    of up to ``hot`` classes leads to each of them; one of more leads to the places and sizes of its classes only, and each
    part of the tokens about a window then leads to the classes that have it.
    """
    classes = found.select("seed", "offset", "near", "cls").distinct()
    often = classes.groupBy("seed").count().where(F.col("count") > hot).select("seed")
    plain = classes.join(often, "seed", "left_anti").select("seed", "offset", "near", "cls", F.lit(None).cast("int").alias("size"))
    many = classes.join(often, "seed").withColumn("size", F.size("near"))
    places = many.select("seed", "offset", F.lit(None).cast("array<bigint>").alias("near"), F.lit(None).cast("bigint").alias("cls"), "size").distinct()
    marked = F.xxhash64("seed", "offset")
    parts = many.select("seed", F.explode(_parts(marked, F.col("size"), similarity, lambda p: F.get("near", p))).alias("part"), F.col("near").alias("part_near"), F.col("cls").alias("part_cls"))
    return plain.unionByName(places).checkpoint(), parts.checkpoint(), found.select("cls", "item_id").distinct()


def _verified(docs: DataFrame, keys: list[Column], text_col: str, items: DataFrame, similarity: float, block: int, hot: int) -> DataFrame:
    """(_key0, _key1 ..., item_id, first_token, overlap): keys and items with a verified hit."""
    shared_dir(docs.sparkSession)
    names = [f"_key{k}" for k in range(len(keys))]
    found, lengths = seeds(items)
    found = found.withColumn("cls", F.xxhash64("seed", "offset", "near")).checkpoint()
    lookup, parts_of, items_of = _tables(found, similarity, hot)
    blocks = max(1, -(-max(lookup.count(), parts_of.count()) // block))
    texts = docs.select(*(c.alias(n) for c, n in zip(keys, names, strict=True)), token_hashes(F.col(text_col)).alias("_all"))
    # A slice has the tokens of its windows and those compared around them; its first window is at ``_lead``.
    n = F.size("_all")
    cut = lambda i: F.struct(i.alias("base"), F.slice("_all", F.greatest(i - AROUND, F.lit(0)) + 1, SLICE + 3 * AROUND).alias("tokens"))
    parts = texts.select(*names, F.explode_outer(F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(SLICE)), cut))).alias("_part"))
    parts = parts.select(*names, F.col("_part.base").alias("_base"), F.col("_part.tokens").alias("_tokens"))
    lead = F.least(F.lit(AROUND), F.col("_base"))
    windows = _windows(parts, lengths, lead, F.least(F.lit(SLICE), F.size("_tokens") - lead))
    start = F.col("at") - F.col("offset")
    # Only AROUND tokens leave the loop with a hit; ``lead`` of the item's tokens come before the text begins.
    laid = [(start - lead + F.col("_base")).alias("start"), F.slice("_tokens", F.greatest(start, F.lit(0)) + 1, AROUND).alias("around"), F.greatest(-start, F.lit(0)).alias("lead")]
    around = lambda p: F.when(p >= F.col("lead"), F.get("around", p - F.col("lead")))
    asked = F.when(F.col("size").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(_parts(F.xxhash64("seed", "offset"), F.col("size"), similarity, around))
    hits = None
    for b in range(blocks):
        mine = F.pmod("seed", F.lit(blocks)) == b
        of_block = windows.join(F.broadcast(lookup.where(mine)), "seed").select(*names, "seed", "offset", "near", "cls", "size", *laid)
        of_block = of_block.withColumn("part", F.explode(asked)).join(F.broadcast(parts_of.where(mine).drop("seed")), "part", "left")
        hits = of_block if hits is None else hits.unionByName(of_block)
    hits = hits.select(*names, "start", "around", "lead", F.coalesce("near", "part_near").alias("near"), F.coalesce("cls", "part_cls").alias("cls")).where("near IS NOT NULL")
    alike = F.filter(F.sequence(F.lit(0), F.size("near") - 1), lambda k: (k - F.col("lead") < F.size("around")) & (F.get("near", k) == around(k)))
    shared = hits.select(*names, "cls", "start", (F.size(alike) / F.size("near")).alias("share")).where(F.col("share") >= similarity)
    best = lambda first: (F.min(first).alias("first_token"), F.max("share").alias("share"))
    of_class = shared.groupBy(*names, "cls").agg(*best(F.greatest(F.lit(0), F.col("start")))).withColumnRenamed("first_token", "first")
    return of_class.join(items_of, "cls").groupBy(*names, "item_id").agg(*best("first")).withColumnRenamed("share", "overlap")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, block_seeds: int = BLOCK_SEEDS, hot: int = HOT_CLASSES) -> DataFrame:
    """One row per (document, benchmark item) that overlap: ``id_col``, ``item_id``,
    first_token (smallest start of a verified overlap in the document's tokens), overlap (largest
    share of equal tokens).

    A hit is verified if at least ``similarity`` of the AROUND tokens about it (all of the
    item's, if it has fewer) are equal place by place. An item shorter than the masks has to be
    there whole. Null and empty texts and rows with a null id give no row; rows that repeat an id
    count as that document; items that repeat an id count as that item.
    """
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    hits = _verified(docs.where(F.col(id_col).isNotNull()), [F.col(id_col)], text_col, items, similarity, block_seeds, hot)
    return hits.select(F.col("_key0").alias(id_col), "item_id", "first_token", "overlap")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text", similarity: float = SIMILARITY, block_seeds: int = BLOCK_SEEDS, hot: int = HOT_CLASSES) -> DataFrame:
    """``docs`` without the rows whose text overlaps a benchmark item; all their columns.

    Rows are matched by a 128-bit hash of their text, so ids may be null or repeated. The hashes
    to drop are written once in the shared folder and broadcast only up to BROADCAST_IDS of
    them; beyond that the join is a shuffle.
    """
    shared_dir(docs.sparkSession)
    marks = [F.xxhash64(F.col(text_col)), F.xxhash64(F.lit(1), F.col(text_col))]
    items = benchmark.select(F.lit(0).alias("item_id"), F.col(item_text).alias("text"))
    bad = _verified(docs, marks, text_col, items, similarity, block_seeds, hot).select("_key0", "_key1").checkpoint()
    same = (marks[0] == F.col("_key0")) & (marks[1] == F.col("_key1"))
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad, same, "left_anti")


def overlaps_sql(similarity: float = SIMILARITY) -> str:
    """DuckDB SQL for overlaps() of documents and benchmark: windows are compared as text instead of by hashes."""
    words = r"""list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]', ' \0 ', 'g'), '[\s\x0B[:punct:]\p{P}\p{Z}]+'), lambda x: x <> '')"""

    def windows(table: str, key: str, of_item: bool) -> str:
        made = []
        for mark, offsets, width in _kinds(list(range(1, SHORTEST))):
            text = " || ' ' || ".join(f"w[pos + {o + 1}]" for o in offsets)
            bound = f"len(w) - {width} + 1" if mark < len(MASKS) or not of_item else f"CASE WHEN len(w) = {width} THEN 1 ELSE 0 END"
            made.append(f"SELECT {key}, w, pos, '{mark}: ' || {text} AS seed FROM (SELECT {key}, w, unnest(range({bound})) AS pos FROM {table})")
        return " UNION ALL ".join(made)

    return f"""
        WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
        b AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
        seeds AS (SELECT DISTINCT seed, item_id, pos - lo AS shift, w[lo + 1:lo + {AROUND}] AS near
            FROM (SELECT *, greatest(0, least(pos - 6, len(w) - {AROUND})) AS lo FROM ({windows("b", "item_id", True)}))),
        hits AS (SELECT doc_id, item_id, pos - shift AS s, near, w FROM ({windows("d", "doc_id", False)}) JOIN seeds USING (seed)),
        laid AS (SELECT doc_id, item_id, s,
            CAST(len(list_filter(range(len(near)), lambda k: s + k >= 0 AND s + k < len(w) AND w[s + k + 1] = near[k + 1])) AS DOUBLE) / len(near) AS share FROM hits)
        SELECT doc_id, item_id, CAST(min(greatest(0, s)) AS INTEGER) AS first_token, max(share) AS overlap
        FROM laid WHERE share >= {similarity} GROUP BY doc_id, item_id
    """
