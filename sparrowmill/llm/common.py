"""Shared pieces: reading tables, shared-folder checkpoints, Arrow slices, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import by_size, materialize, maybe_among, spread, with_group  # noqa: F401  (for the operators beside)

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
SLICE_BYTES = 1 << 20
#: Rows in an Arrow batch. Texts are of any length, so batches are kept short.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The columns of one input table; only Spark opens the path."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*cols) if cols else frame


def short_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of text small; a session setting, read when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def crc_of_id(col: str = "doc_id") -> Column:
    """crc32 of the decimal id; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def uniform(*cols: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols], F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def slices(lengths, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most ``limit`` bytes together, or one row."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def text_list(column: pa.Array) -> list[str]:
    """Python texts of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def passing(docs: DataFrame, run: Callable, passes: Callable[[pa.Table], pa.ChunkedArray]) -> DataFrame:
    """The rows of ``docs``, all columns, for which ``passes`` is true of what ``run`` tells of them.

    ``run`` takes batches of (doc_id, text) and gives a row for each, in order; so the verdict is on
    the row, whether or not ids are unique or null.
    """
    short_batches(docs.sparkSession)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, told = [], []

        def parts():
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text").cast(pa.string())], names=["doc_id", "text"])

        # All that is told of a batch comes before the next one is read.
        for out in run(parts()):
            told.append(out)
            if sum(x.num_rows for x in told) == waiting[0].num_rows:
                yield waiting.pop(0).filter(passes(pa.Table.from_batches(told)).combine_chunks())
                told.clear()

    return docs.mapInArrow(filtered, docs.schema)


def rebatch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
