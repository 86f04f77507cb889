"""Checked access to arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The error texts.
RANGE_FAILED, ITEM_FAILED, NO_KEY = "Indexing failed: idx:%d..%d target_len:%d", "Slicing failed. index: %d", "Key %s not found"


def _bounds(arr: Column, start: Column, end: Column | None) -> tuple[Column, Column, Column]:
    n = F.size(arr)
    low = F.when(start < 0, n + start).otherwise(start)
    high = n if end is None else F.when(end < 0, n + end).otherwise(end)
    return low, high, (low < 0) | (high > n) | (low > high)


def try_signed_slice(arr: Column, start: Column, end: Column | None = None) -> Column:
    """From ``start`` to before ``end``; negative numbers count from the end; null out of range."""
    low, high, outside = _bounds(arr, start, end)
    return F.when(~outside, F.slice(arr, F.greatest(low, F.lit(0)) + 1, F.greatest(high - low, F.lit(0))))


def signed_slice(arr: Column, start: Column, end: Column | None = None) -> Column:
    """As ``try_signed_slice``, but raises out of range."""
    low, high, outside = _bounds(arr, start, end)
    text = F.format_string(RANGE_FAILED, low, high, F.size(arr))
    return F.when(arr.isNull(), arr).when(outside, F.element_at(F.array(arr), F.raise_error(text).cast("int"))).otherwise(try_signed_slice(arr, start, end))


def item(arr: Column, index: Column) -> Column:
    """The item at a 0-based index; raises out of range."""
    text = F.format_string(ITEM_FAILED, index)
    outside = (index < 0) | (index >= F.size(arr))
    return F.when(outside, F.element_at(arr, F.raise_error(text).cast("int"))).otherwise(F.get(arr, index.cast("int")))


def try_item(arr: Column, index: Column) -> Column:
    return F.get(arr, index.cast("int"))


def value_of(map_: Column, key: Column) -> Column:
    """The value of a key; raises if the map hasn't it."""
    text = F.format_string(NO_KEY, key)
    return F.when(F.map_contains_key(map_, key), F.try_element_at(map_, key)).otherwise(
        F.element_at(F.map_values(map_), F.raise_error(text).cast("int"))
    )


def present(value: Column, message: str) -> Column:
    """The value; raises with ``message`` if it is null."""
    return F.coalesce(value, F.element_at(F.array(value), F.raise_error(F.lit(message)).cast("int")))


def utf8(data: Column) -> Column:
    """Bytes as text; raises if they aren't UTF-8."""
    return F.validate_utf8(data.cast("string"))


def try_utf8(data: Column) -> Column:
    return F.try_validate_utf8(data.cast("string"))


def with_index(value: Column, index: Column) -> Column:
    """``struct(index, data)``."""
    return F.struct(index.alias("index"), value.alias("data"))


def tagged(kind: str, value: Column) -> Column:
    """``struct(kind, value)``: one case of several, named."""
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))
