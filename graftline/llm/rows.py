"""Arrow plumbing shared by the text operators: rows pass through in slices of bounded bytes, new columns are appended."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

SLICE_BYTES = 1 << 18
ARROW_ROWS = 1_000
_ROWS_OF_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """Let the session hand texts to Python in batches of at most ARROW_ROWS rows, as a batch is held whole on both sides."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS_OF_A_BATCH)) <= ARROW_ROWS:
        conf.set(_ROWS_OF_A_BATCH, str(ARROW_ROWS))
    return df


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows whose bytes stay under `most`; a longer row is a run of its own."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i - start
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes) - start


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, length, texts) of runs of rows; only one run's texts are held at a time."""
    sizes = pc.binary_length(column).fill_null(0).to_pylist()
    for start, n in slices(sizes, most):
        yield start, n, texts(column.slice(start, n))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The frame without columns of these names, in any case; what an operator adds replaces what came under the same name."""
    gone = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in gone])


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def one_text(labelled: DataFrame) -> DataFrame:
    """(id, label, text) with one row for each id: the first of its texts by hash, found before the shuffle."""
    return labelled.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def add_from_text(df: DataFrame, text_col: str, added: list[tuple[str, DataType]], make: Callable[[], Callable[[list[bytes]], list[pa.Array]]], keep_text: bool = True) -> DataFrame:
    """Append columns computed from the text column, task by task.

    `make` runs once in each task and returns the function from texts to arrays, one array for each added column.  Input columns
    with the name of an added one are replaced; the text goes on to the result unless `keep_text` is off."""
    names = [n for n, _ in added]
    small_batches(df)
    carried = without(df, names if keep_text else [*names, text_col])
    shown = text_col in carried.columns
    staged = df.select(*[quoted(c) for c in carried.columns], *([] if shown else [quoted(text_col).alias("__text")]))
    place, width = (carried.columns.index(text_col) if shown else len(carried.columns)), len(carried.columns)
    schema = StructType([*carried.schema.fields, *[StructField(n, t) for n, t in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start, n, data in text_slices(batch.column(place)):
                part = batch.slice(start, n)
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *work(data)], [*part.schema.names[:width], *names])

    return staged.mapInArrow(run, schema)
