"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows turned into Python objects at a time inside a task.
SLICE_ROWS = 256


#: Rows of whole texts that Spark hands to a Python worker in one Arrow batch.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session: rows hold whole texts, and a batch is in memory at once on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one named in ``spark.checkpoint.dir``; only where that is unset
    in a local run (tests) a temporary folder is made and set. A cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if not current and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = current or tempfile.mkdtemp(prefix="spark-")
        if not current:
            spark.sparkContext.setCheckpointDir(found)
        return found
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back: cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, columns: list[str], make: Callable[[], Callable], schema: str) -> DataFrame:
    """Arrow map over ``columns`` only.

    ``make()`` runs once per task and returns ``work(*columns)``, which gets a
    slice's columns as lists and returns one list or array per output column.
    Extra columns of ``df`` never reach the operator, whatever their names are.
    """
    out_type = T.StructType.fromDDL(schema)

    def run(batches):
        work = make()
        target = to_arrow_schema(out_type)
        for part in slices(batches):
            made = work(*(part.column(i).to_pylist() for i in range(part.num_columns)))
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(made, target, strict=True)],
                schema=target,
            )

    return df.select(*columns).mapInArrow(run, out_type)


def bounded_ids(labelled: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most ``rows`` ids in a fixed pseudo-random order (the training-sample bound)."""
    return (
        labelled.groupBy(id_col).agg(F.lit(1).alias("_one")).select(id_col)
        .orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(rows)
    )
