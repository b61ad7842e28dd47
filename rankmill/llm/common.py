"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ASCII white space, as the contracts of word-based operators define it.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    """The whole text; null counts as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_words(text: Column) -> Column:
    """Array of the words between runs of ASCII white space; null and blank texts have none.

    Splitting leaves an empty string where a text starts or ends with white space; those go.
    """
    return F.array_remove(F.split(text_or_empty(text), SPACE_CLASS, -1), "")


def id_remainder(column: Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo modulus; null ids count as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def checkpoint_dir(spark: SparkSession) -> None:
    """Leaves the session's checkpoint folder alone; where none is set, takes the one that spark.checkpoint.dir names.

    Without either the caller is told: a folder of the driver's own would be out of the executors' sight.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and context.master.startswith("local") and not context.master.startswith("local-cluster"):
            import tempfile

            named = tempfile.mkdtemp(prefix="rankmill-checkpoint-")  # one process: its own folder is everyone's
        if not named:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named)


def pack(docs: DataFrame, extra: dict[str, Column]) -> tuple[DataFrame, list[str]]:
    """(docs with its columns under numbered names beside the extra ones, those numbered names): no column's name can clash or be misread."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    own = [F.col(f"`{c.replace('`', '``')}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]
    return docs.select(*own, *[value.alias(name) for name, value in extra.items()]), names


def unpack(packed: DataFrame, docs: DataFrame, added: Sequence[str] = ()) -> DataFrame:
    """The columns of docs, under their own names, of what pack() made, then the added ones; these replace columns of docs of the same name."""
    own = [F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in added]
    return packed.select(*own, *added)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS, where they are more: a batch holds whole texts, in the JVM and in Python."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_runs(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of rows whose texts, the last column, hold about limit bytes, or of one text, whichever is larger."""
    texts = batch.column(batch.num_columns - 1)
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    low = 0
    while low < batch.num_rows:
        done = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(low, high - low)
        low = high


def map_texts(
    docs: DataFrame, text_col: str, carry: list[str], compute: Callable[[list[bytes | None]], dict[str, Sequence]], fields: str, limit: int = 1 << 20,
    at_end: Callable[[], None] | None = None,
) -> DataFrame:
    """The columns in carry and, for each row, the columns (fields: a schema string) that compute makes of whole texts.

    compute gets the UTF-8 texts (None for null) of a run of rows and returns as many values for each new column. A run holds
    about limit bytes or one text, whichever is larger; Arrow batches are cut into such runs before any text becomes a Python
    object. The columns in carry pass through as they are. at_end runs after a task's last row: Python workers outlive their
    tasks, and what one operator remembers is memory that the next one lacks.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text_col).cast("string").alias("__text"))
    kinds = to_arrow_schema(StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_runs(batch, limit):
                made = compute(piece.column(piece.num_columns - 1).cast(pa.large_binary()).to_pylist())
                new = [pa.array(made[f.name], type=f.type, from_pandas=True) for f in kinds]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *new], names=[*carry, *kinds.names])
        if at_end is not None:
            at_end()
        pa.default_memory_pool().release_unused()
        trim()

    same = StructType([*kept.schema.fields[:-1], *StructType.fromDDL(fields).fields])
    return kept.mapInArrow(run, same)


def forget(shared: Broadcast) -> None:
    """Drops a worker's copy of a broadcast value; a later task reads it again. Workers outlive the operator, and keep every value they read."""
    if getattr(shared, "_path", None) is not None:
        shared.__dict__.pop("_value", None)


def trim() -> None:
    """Gives the C library's free memory back to the system, where the library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def popcount(values: np.ndarray) -> np.ndarray:
    """Set bits of each unsigned 64-bit value."""
    return np.bitwise_count(values)
