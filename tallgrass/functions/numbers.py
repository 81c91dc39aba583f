"""Number and digest expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def safe_ratio(n: Column | str, d: Column | str) -> Column:
    """n / d, and 0 where d is 0."""
    return F.when(col(d) == 0, 0.0).otherwise(col(n) / col(d))


def percent_change(base: Column | str, new: Column | str) -> Column:
    """Null where the base is null or 0."""
    return F.when(col(base) != 0, (col(new) - col(base)) * 100.0 / col(base))


def per_second(tokens: Column | str, elapsed_ms: Column | str) -> Column:
    return F.when(col(elapsed_ms) > 0, col(tokens) * 1000.0 / col(elapsed_ms)).otherwise(0.0)


def blocks(tokens: Column | str, size: int) -> Column:
    """Blocks of size that hold the tokens; none for none."""
    return F.when(col(tokens) > 0, F.floor((col(tokens) + (size - 1)) / size)).otherwise(0).cast("long")


def whole_blocks(tokens: Column | str, size: int) -> Column:
    """Tokens in full blocks."""
    return (F.floor(col(tokens) / size) * size).cast("long")


def strict_sum(x: Column | str) -> Column:
    """Null if one value is null."""
    return F.when(F.count(col(x)) == F.count("*"), F.sum(col(x)))


def json_count(json: Column | str, path: str) -> Column:
    """A whole non-negative number at the JSON path; anything else, true and false included, is null."""
    found = F.get_json_object(col(json), path)
    return F.when(found.rlike("^[0-9]{1,18}$"), found.cast("long"))


def fingerprint(*parts: Column | str) -> Column:
    """SHA-256 of the parts, nulls marked apart from empty texts."""
    marked = [F.coalesce(F.concat(F.lit("="), col(p).cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("\x00", *marked), 256)


def batch_cost(prefill: Column | str, decode: Column | str, members: Column | str, context: Column | str) -> Column:
    """Milliseconds of one step of a serving batch: bases and token costs, a discount for company, and the contexts read."""
    # Fixed values of the cost model.
    prefill_base, prefill_token, decode_base, decode_token = 1.0, 0.08, 0.6, 0.22
    discount_each, discount_most, context_token = 0.08, 0.7, 0.002
    work = F.when(col(prefill) > 0, prefill_base + col(prefill) * prefill_token).otherwise(0.0) + F.when(
        col(decode) > 0, decode_base + col(decode) * decode_token
    ).otherwise(0.0)
    discount = F.least(F.lit(discount_most), (col(members) - 1) * discount_each)
    return work * (1 - discount) + col(context) * context_token
