"""Strict readers: explicit schemas, fail-fast parsing, key and digest assertions."""

from __future__ import annotations

import json
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a temporary one only in a local run where none is set."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))


def parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def strict_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document per file; any malformed file fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per line, blank lines skipped; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def unique_index(df: DataFrame, key: str) -> DataFrame:
    """``df``, or an error that names a repeated or empty key."""
    n = F.count("*").over(Window.partitionBy(key))
    bad = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "") | (F.col("_n") > 1)
    checked = df.withColumn("_n", n).withColumn("_ok", F.when(bad, F.raise_error(F.concat(F.lit(f"duplicate or empty {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.lit(True)))
    return checked.where("_ok").drop("_n", "_ok")


def exact_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(line, row, error): JSON lines that refuse repeated keys, NaN and infinities; the row is canonical JSON."""

    def pairs(items):
        found = dict(items)
        if len(found) != len(items):
            raise ValueError("repeated key")
        return found

    def constant(name):
        raise ValueError(f"{name} is not JSON")

    def parse(batches):
        for batch in batches:
            lines, rows, errors = batch.column("value").to_pylist(), [], []
            for line in lines:
                try:
                    row = json.loads(line, object_pairs_hook=pairs, parse_constant=constant)
                    if not isinstance(row, dict):
                        raise ValueError("not an object")
                    rows.append(json.dumps(row, sort_keys=True, ensure_ascii=False, separators=(",", ":")))
                    errors.append(None)
                except ValueError as error:
                    rows.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(rows, pa.string()), pa.array(errors, pa.string())], names=["line", "row", "error"])

    return spark.read.text(path).where("trim(value) <> ''").mapInArrow(parse, "line string, row string, error string")


def verified_bytes(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Manifest rows (sha256, size) with the landed content that has the digest and size; ``verified`` tells."""
    landed = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256"), F.col("length").alias("_size"), "content")
    joined = manifest.join(landed.dropDuplicates(["sha256"]), "sha256", "left")
    return joined.withColumn("verified", F.coalesce(F.col("_size") == F.col("size"), F.lit(False))).drop("_size")


def pasted_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pasted text as blocks: one per line with text, the first one a heading."""
    lines = df.select(id_col, F.posexplode(F.filter(F.transform(F.split(text_col, "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("ordinal", "text"))
    return lines.withColumn("kind", F.when(F.col("ordinal") == 0, "heading").otherwise("paragraph"))
