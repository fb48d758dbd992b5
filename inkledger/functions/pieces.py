"""Column functions on texts that see a bounded number of characters at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Characters and rows of a piece; a longer text is a piece of its own. What a word of a list counts as.
MOST, ROWS, WORD = 1 << 20, 1 << 10, 16
NUMBERS = ("int", "double")


def cuts(sizes: list[int], most: int = MOST, rows: int = ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` characters and ``rows`` rows."""
    at, held = 0, 0
    for k, n in enumerate(sizes):
        if k > at and (held + n > most or k - at >= rows):
            yield at, k
            at, held = k, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def _sizes(arrays: Sequence[pa.Array]) -> list[int]:
    """Bytes of the texts of each row, those in lists too; each word of a list counts ``WORD`` more."""
    total = np.zeros(len(arrays[0]), np.int64)
    for x in arrays:
        if pa.types.is_list(x.type) or pa.types.is_large_list(x.type):
            n = pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False)
            total += WORD * n
            if pa.types.is_string(x.type.value_type) or pa.types.is_large_string(x.type.value_type):
                upto = np.append(0, np.cumsum(pc.binary_length(x.flatten()).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64))
                total += np.diff(upto[np.append(0, np.cumsum(n, dtype=np.int64))])
        elif pa.types.is_string(x.type) or pa.types.is_binary(x.type) or pa.types.is_large_string(x.type) or pa.types.is_large_binary(x.type):
            total += pc.binary_length(x).fill_null(0).to_numpy(zero_copy_only=False)
    return total.tolist()


def _array(out: pd.Series | pd.DataFrame, kind: pa.DataType) -> pa.Array:
    if isinstance(out, pd.DataFrame):
        return pa.StructArray.from_arrays([pa.array(out.iloc[:, k], f.type, from_pandas=True) for k, f in enumerate(kind)], fields=list(kind))
    return pa.array(out, kind, from_pandas=True)


def in_pieces(make: Callable[[], Callable], kind: str, columns: int = 1):
    """An Arrow UDF of ``columns`` columns that runs ``make()``, made once a task, on pieces of each batch as pandas series.

    Only a piece of a batch is ever held as Python objects. Wide results leave piece by piece; functions that give numbers take
    a batch at once, so that Spark can run several of them in one worker. ``kind`` with several fields takes frames.
    """
    made = to_arrow_type(DataType.fromDDL(kind))

    def pieces(arrays: Sequence[pa.Array], f: Callable) -> Iterator[pa.Array]:
        if not len(arrays[0]):
            yield pa.array([], made)
        for i, j in cuts(_sizes(arrays)):
            yield _array(f(*(x.slice(i, j - i).to_pandas() for x in arrays)), made)

    if kind in NUMBERS:
        held = []

        def whole(arrays: Sequence[pa.Array]) -> pa.Array:
            if not held:
                held.append(make())
            return pa.concat_arrays(list(pieces(arrays, held[0])))

        def number(a: pa.Array) -> pa.Array:
            return whole([a])

        def number_of_two(a: pa.Array, b: pa.Array) -> pa.Array:
            return whole([a, b])

        return F.arrow_udf({1: number, 2: number_of_two}[columns], kind)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for array in batches:
            yield from pieces([array], f)

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        f = make()
        for arrays in batches:
            yield from pieces(arrays, f)

    return F.arrow_udf(one if columns == 1 else several, kind)
