"""Substring dedup by content-defined chunks.

A gear rolling hash of the last bytes cuts texts where its value is small, so cuts depend on
content only and chunk borders come back into step after an insertion. Chunks are compared by
a 128-bit digest over all texts. Each chunk that stands in two places or more has one owner,
its first place; runs of such chunks are the repeated passages, split where ownership changes,
and only what is owned elsewhere may be cut. Digests are pre-aggregated before the shuffle, so
a chunk that a third of all documents share is one row a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_type, slices, written

#: One position in DIVISOR is a cut on average; chunks have MIN to MAX bytes (a text's last may be shorter).
DIVISOR, MIN, MAX = 40, 16, 160
#: Bytes that the hash looks back on.
REACH = 16
#: A repeated passage has at least so many bytes of whole repeated chunks.
LEAST_BYTES = 96

#: The gear table: a fixed rule gives each byte its 32-bit number.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 2024) for b in range(256)], dtype=np.uint32)


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of ``raw`` (UTF-8); b"" has none. No cut is inside a character."""
    n = len(raw)
    if not n:
        return []
    octets = np.frombuffer(raw, dtype=np.uint8)
    h = GEAR[octets]
    width = 1
    while width < REACH:  # the sum over the last 2 * width bytes from two sums over width bytes
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    # Bits 4 to 15 depend on at most REACH bytes.
    key = (h >> np.uint32(4)) & np.uint32(0xFFF)
    key[:-1][(octets[1:] & 0xC0) == 0x80] = 0xFFFF  # the next byte goes on with the same character
    small = (np.flatnonzero(key < 4096 // DIVISOR) + 1).tolist()
    out, last = [], 0

    def forced(last: int) -> int:
        """Where no hash is small: the last place with the window's smallest hash, so periodic text is cut in phase."""
        window = key[last + MIN - 1 : last + MAX]
        return last + MIN + len(window) - 1 - int(window[::-1].argmin())

    for at in [*small, n]:
        while at - last > MAX:
            last = forced(last)
            out.append(last)
        if at - last >= MIN or (at == n and at > last):
            out.append(at)
            last = at
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, row, no, start, size, hi, lo): the chunks of each whole text in UTF-8 bytes, with their digests.

    ``row`` is a hash of the text, which tells rows with the same id apart. Null and empty texts have none.
    """
    schema = f"`{id_col}` {id_type(docs, id_col)}, row bigint, no int, start bigint, size int, hi bigint, lo bigint"

    def run(batches):
        for part in slices(batches, 64):
            at, no, start, size, digests = [], [], [], [], []
            for row, text in enumerate(part.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "replace")
                ends = cuts(raw)
                begins = [0, *ends[:-1]] if ends else []
                at.append(np.full(len(ends), row))
                no.append(np.arange(len(ends), dtype=np.int32))
                start.append(np.array(begins, dtype=np.int64))
                size.append(np.diff(np.array([0, *ends], dtype=np.int64)).astype(np.int32) if ends else np.empty(0, np.int32))
                digests += [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begins, ends, strict=True)]
            both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            columns = [pa.array(np.concatenate(x)) for x in (no, start, size)]
            places = pa.array(np.concatenate(at).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(places), part.column(1).take(places), *columns, pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))],
                names=[id_col, "row", "no", "start", "size", "hi", "lo"],
            )

    return docs.select(F.col(id_col), _row(text_col).alias("row"), F.col(text_col)).mapInArrow(run, schema)


def _row(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks that stand in two places or more, in one text or in several, with ``first``, the smallest id that has them.

    The shared digests are written first, so that the join's sides are plain shuffles and a
    digest of very many documents can be split between tasks.
    """
    found = chunks(docs, id_col, text_col)
    places = [F.min(c).alias(f"_a{k}") for k, c in enumerate((id_col, "row", "start"))] + [F.max(c).alias(f"_z{k}") for k, c in enumerate((id_col, "row", "start"))]
    shared = found.groupBy("hi", "lo").agg(*places).where("_a0 <> _z0 OR _a1 <> _z1 OR _a2 <> _z2").select("hi", "lo", F.col("_a0").alias("first"))
    return found.join(written(shared, "shared-chunks"), ["hi", "lo"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_BYTES) -> DataFrame:
    """One row per repeated passage: ``id_col``, row, start, end (UTF-8 bytes, end exclusive), n_chunks, first_id, kept.

    A run is a maximal row of neighbouring repeated chunks, of ``least`` bytes or more; it may
    repeat other documents or other places of its own text. A chunk is owned where it is
    first: in the smallest id, there by ``row`` (a hash of the text) and start. A run gives one row for each stretch
    that is owned here (``kept``) or elsewhere, so every chunk is in a kept stretch, or in no run, at
    its first place. ``first_id`` is the smallest id that has the stretch's first chunk.

    Documents without a repeated passage give no row; null and empty texts have none; rows with
    a null id are left out. Rows that repeat an id with another text are told apart by
    ``row``; rows that repeat both are one text.
    """
    found = repeated_chunks(docs.where(F.col(id_col).isNotNull()), id_col, text_col).select(id_col, "row", "no", "start", "size", "hi", "lo", "first")
    first_place = F.dense_rank().over(Window.partitionBy(id_col, "hi", "lo").orderBy("row", "start")) == 1
    text = Window.partitionBy(id_col, "row")
    stretches = (
        found.repartition(F.col(id_col)).select(id_col, "row", "no", "start", "size", "first", ((F.col("first") == F.col(id_col)) & first_place).alias("kept"))
        .withColumn("_run", F.col("no") - F.dense_rank().over(text.orderBy("no")))
        .withColumn("_part", F.col("no") - F.dense_rank().over(Window.partitionBy(id_col, "row", "kept").orderBy("no")))
        .groupBy(id_col, "row", "_run", "kept", "_part")
        .agg(
            F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), (F.max("no") - F.min("no") + 1).alias("n_chunks"),
            F.min_by("first", "no").alias("first_id"),
        )
    )
    whole = F.sum(F.col("end") - F.col("start")).over(Window.partitionBy(id_col, "row", "_run"))
    return stretches.withColumn("_whole", whole).where(F.col("_whole") >= least).select(id_col, "row", "start", "end", "n_chunks", "first_id", "kept")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_BYTES) -> DataFrame:
    """``docs`` with every repeated passage cut but where it is first; each chunk of it stays there.

    Other columns, null texts and rows with a null id stay as they are.
    """
    gone = (
        repeated_passages(docs, id_col, text_col, least).where("NOT kept").groupBy(F.col(id_col).alias("_id"), F.col("row").alias("_row"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_gone"))
    )

    @F.arrow_udf("string")
    def cut(texts, gone):
        out = []
        for text, spans in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
            if text is not None and spans:
                raw, parts, at = text.encode("utf-8", "replace"), [], 0
                for s in spans:
                    parts.append(raw[at : s["start"]])
                    at = s["end"]
                text = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
            out.append(text)
        return pa.array(out, pa.string())

    own = (F.col(id_col) == F.col("_id")) & (_row(text_col) == F.col("_row"))
    return docs.join(gone, own, "left").withColumn(text_col, cut(F.col(text_col), F.col("_gone"))).select(*docs.columns)
