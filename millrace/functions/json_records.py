"""Records in JSON text as column expressions, for input known to be clean; the strict parser is in operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_fences

#: Keys under which an answer may wrap its array, in order.
WRAPPERS = ("items", "records", "data", "results", "rows", "entries")


def is_json(x: Column) -> Column:
    """An array or object that ends where the text ends."""
    whole = x.rlike(r"[\]}]\s*$")
    return F.coalesce((F.json_array_length(x).isNotNull() | F.json_object_keys(x).isNotNull()) & whole, F.lit(False))


def records_json(text: Column) -> Column:
    """Array text of an answer: as it is, unwrapped, or one object in an array; null if it is neither."""
    x = strip_fences(text)
    first = lambda k: F.get_json_object(x, f"$.{k}")
    wrapped = F.coalesce(*[F.when(F.json_array_length(first(k)).isNotNull() & first(k).startswith("["), first(k)) for k in WRAPPERS])
    return F.when(~is_json(x), None).when(F.json_array_length(x).isNotNull(), x).otherwise(F.coalesce(wrapped, F.concat(F.lit("["), x, F.lit("]"))))
