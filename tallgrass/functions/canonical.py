"""One text for one value: JSON that does not depend on the order of fields or entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, MapType, StringType, StructType, TimestampType

#: Characters with a short escape; other control characters are written as \\u00xx.
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def quoted(text: Column) -> Column:
    """A JSON string; what is beyond ASCII stays as it is."""
    safe = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = safe
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(_SHORT.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x1f]"), escaped).otherwise(safe), F.lit('"'))


def canonical_json(value: Column, kind: DataType) -> Column:
    """JSON of a value of that type without white space, names and keys in order of their bytes, null for null.

    Structs give all their fields, also null ones. Numbers are written as Spark writes them, dates and times as strings.
    Expressions only, nested as deep as the type.
    """
    return F.coalesce(_text(value, kind), F.lit("null"))


def _text(value: Column, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode())
        parts = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical_json(value.getField(f.name), f.dataType)) for f in fields]
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    if isinstance(kind, ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    if isinstance(kind, MapType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value"))))
        pair = lambda e: F.concat(quoted(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType))
        return F.concat(F.lit("{"), F.array_join(F.transform(entries, pair), ","), F.lit("}"))
    if isinstance(kind, StringType | DateType | TimestampType):
        return quoted(value.cast("string"))
    return value.cast("string")


def canonical_digest(value: Column, kind: DataType) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(value, kind), 256)
