"""What several operators share: tables, shared storage and text rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; our own only where none is named and all runs on this machine (as in tests)."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return "file:///tmp/checkpoints"


#: Bytes of an Arrow batch that goes to a Python worker inside ``small_batches``.
BATCH_BYTES, _BATCH_CONF = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send texts to Python workers in small batches, so that the memory of both sides doesn't follow the
    texts' length; afterwards the session is as it was."""
    before = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/strandline-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._materialized = path  # for ``release``
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` gave. Nothing that is still to run may read them."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._materialized)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Bytes of text that a Python worker turns into pandas at once, and of a batch that it gives back.
SLICE_BYTES, OUT_BYTES = 1 << 20, 1 << 20


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes of strings, one row at least."""
    rows = np.full(batch.num_rows, 64, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            rows += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(rows), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], fields: str, size: int = SLICE_BYTES) -> DataFrame:
    """mapInPandas over slices of batches: only about ``size`` bytes of text are Python objects at a time, however large the
    session's batches are. Integers with nulls come as objects and so keep all their digits."""
    schema = to_arrow_schema(StructType.fromDDL(fields))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        for frame in run(s.to_pandas(integer_object_nulls=True) for b in batches for s in slices(b, size)):
            if len(frame):
                out.append(pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False))
            if sum(b.nbytes for b in out) > OUT_BYTES:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return df.mapInArrow(sliced, fields)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that to a text without other letters, and is much faster."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def sql_lower_ascii(text: str) -> str:
    return f"translate({text}, '{ascii_uppercase}', '{ascii_lowercase}')"


#: Rows, and bytes as Spark estimates them, up to which a table is broadcast; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 32 << 20


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a materialized table (or a part of one) for broadcast if it is small by its files and its rows; else leaves it to Spark."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows else df
