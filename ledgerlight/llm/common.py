"""Helpers shared by the operators: whole texts out of Arrow batches, and row-by-row batch mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of a batch are worked on in runs of about this many characters, so that arrays stay small whatever the texts.
RUN_CHARS = 1_000_000
#: Rows of an Arrow batch at most: whole texts are far larger than the rows that Spark's default is meant for.
BATCH_ROWS = 500
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch, so that a task holds few texts at a time on either side of the pipe."""
    rows = int(spark.conf.get(BATCH_SETTING))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def text_runs(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts (null: empty), each of about RUN_CHARS characters or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        held += n
        if held >= RUN_CHARS or i == len(lengths) - 1:
            part = batch.slice(start, i + 1 - start)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            start, held = i + 1, 0


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch, list[str]], list], schema: str, setup: Callable | None = None) -> DataFrame:
    """Apply ``work`` to every run of ``df`` (columns as selected, one named text); it returns columns in ``schema`` order.

    ``setup`` runs once in each task and its result is passed to ``work`` as third argument.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = (setup(),) if setup else ()
        for batch in batches:
            for part, texts in text_runs(batch):
                columns = work(part, texts, *more)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)],
                    schema=arrow,
                )

    return df.mapInArrow(run, struct)
