"""What the operators of this subpackage share.

All of them take a DataFrame with an id and a text column, select what they
need, and ignore every further column, whatever its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Stands for a null document id where an order or a key is needed.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def hex_number(digits: Column) -> Column:
    """A string of up to 15 hexadecimal digits as a long."""
    return F.conv(digits, 16, 10).cast("long")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column in ``taken`` is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def map_texts(docs: DataFrame, text_col: str, make, fields: str) -> DataFrame:
    """``docs`` with columns computed from the text by an Arrow function.

    ``make()`` is called once in each task and gives a function from a list of
    texts (null as empty) to one pyarrow array for each of ``fields`` (a schema
    string).  Columns of ``docs`` that are named like one of ``fields`` are
    replaced.
    """
    new = StructType.fromDDL(fields)
    names = {f.name.lower() for f in new}
    kept = [c for c in docs.columns if c.lower() not in names or c == text_col]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    if text_col.lower() in names:
        raise ValueError(f"a result can't be named like the text column {text_col}")
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(texts)], names=out)

    out = [*kept, *(f.name for f in new)]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *new.fields]))
