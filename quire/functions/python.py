"""Python functions of one text as columns, in memory that the input's size does not enter.

Spark hands a worker up to 10,000 rows at once.  They stay as they came; one text at a time becomes
a Python object, and results leave after some rows, so neither the texts of a batch nor its results
are ever held as objects together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Results leave after so many rows, or sooner, after so many characters of text.
ROWS, CHARS = 256, 1 << 20


def in_parts(function: Callable[[str], Any], batches: Iterator[pa.Array], kind: pa.DataType, null: str | None = None) -> Iterator[pa.Array]:
    """function of each text, in arrays of few rows."""
    held: list[Any] = []
    size = 0
    for batch in batches:
        for value in batch:
            text = value.as_py()
            text = null if text is None else text
            held.append(None if text is None else function(text))
            size += len(text or "")
            if len(held) >= ROWS or size >= CHARS:
                yield pa.array(held, kind)
                held, size = [], 0
        if held:
            yield pa.array(held, kind)
            held, size = [], 0


def per_text(make: Callable[[], Callable[[str], Any]], kind: str, c: Column | str, null: str | None = None) -> Column:
    """make()(text) of each text as a column of type kind; make is called once a task.  A null text
    gives null, or counts as the text `null`."""
    arrow = to_arrow_type(DataType.fromDDL(kind))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return in_parts(make(), batches, arrow, null)

    return F.arrow_udf(run, kind)(F.col(c) if isinstance(c, str) else c)
