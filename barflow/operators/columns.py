"""Arrow columns as lists, for folds that go row by row."""

from __future__ import annotations

import pyarrow as pa


def values(column: pa.Array) -> list:
    """`column.to_pylist()` in a fraction of its time: numbers by way of numpy, each distinct string made once."""
    kind = column.type
    if column.null_count:
        return column.to_pylist()
    if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        coded = column.dictionary_encode()
        names = coded.dictionary.to_pylist()
        return [names[i] for i in coded.indices.to_numpy().tolist()]
    return column.to_pylist()
