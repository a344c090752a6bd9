"""Helpers shared by the operators: per-row passes, hold-out splits, written tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A batch function: the texts of a record batch (UTF-8, None for null) in,
#: one Arrow array per output field out.
BatchFn = Callable[[list], Sequence[pa.Array]]


def annotate(
    df: DataFrame,
    text_col: str,
    fields: Sequence[tuple[str, T.DataType]],
    make: Callable[[], BatchFn],
) -> DataFrame:
    """``df`` with one column per field, computed from ``text_col`` batch by batch.

    ``make`` runs once per task and returns the batch function, so that models
    are opened once.  The pass is narrow (no shuffle) and holds one Arrow batch
    at a time.  An input column named like an output field is replaced.
    """
    names = [n for n, _ in fields]
    kept = [c for c in df.columns if c not in names or c == text_col]
    source = df.select(*[F.col(quoted(c)) for c in kept])
    at = kept.index(text_col)
    drop_text = text_col in names
    fields_in = [f for f in source.schema.fields if not (drop_text and f.name == text_col)]
    schema = T.StructType([*fields_in, *[T.StructField(n, t, True) for n, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for b in batches:
            made = list(score(utf8(b.column(at))))
            cols = [c for i, c in enumerate(b.columns) if not (drop_text and i == at)]
            yield pa.RecordBatch.from_arrays([*cols, *made], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def key_text(col: Column) -> Column:
    """A column as text, '' for null: what hold-out splits hash."""
    return F.coalesce(col.cast("string"), F.lit(""))


def fold(col: Column, folds: int) -> Column:
    """crc32 of the column as text, modulo ``folds`` (null hashes as '')."""
    return F.pmod(F.crc32(key_text(col).cast("binary")), F.lit(folds)).cast("int")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Unset, a local master gets a temporary folder; on a cluster that would be
    one machine's disk, so it is an error there.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="trestle-llm-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut of lineage that outlives executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: White space as the contracts of the operators define it.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
