"""Running a plain function over every (id, text) row of a table in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 500


def each_block(docs: DataFrame, work: Callable[[list[str]], list[tuple]], schema: str, key: str = "doc_id") -> DataFrame:
    """``work`` turns a block of whole texts (null: empty) into one tuple a text; the result is (key, *tuple).

    ``schema`` names the columns of the tuple.  Blocks are small, so memory is bounded by them and by the longest text.
    """
    slim = docs.select(F.col(key), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    full = StructType.fromDDL(schema)
    result = StructType([slim.schema[key], *full.fields])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = zip(*work(part.column(1).to_pylist()), strict=True)
                columns = [pa.array(c, f.type) for c, f in zip(found, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[key, *arrow.names])

    return slim.mapInArrow(run, result)


def checksum(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end of every span, comma-joined in the order given."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
