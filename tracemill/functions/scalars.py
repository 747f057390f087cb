"""Column expressions for ratios, differences, keys and lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0.0 where the denominator is 0 or NULL."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def rate_or_null(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, NULL where the denominator is not positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double"))


def mean(x: Column) -> Column:
    """Mean of a group's doubles. Where 12 decimal places hold all of them it is exact, so that halves round up however rows are dealt out; else doubles are summed as they come."""
    held = x.try_cast("decimal(26,12)")
    exact = F.every(x.isNull() | F.coalesce(held.cast("double") == x, F.lit(False)))
    return F.when(exact, (F.sum(held) / F.count(x)).cast("double")).otherwise(F.avg(x))


def f1(precision: Column, recall: Column) -> Column:
    return rate(F.lit(2.0) * precision * recall, precision + recall)


def difference(a: Column, b: Column) -> Column:
    """a - b, 0.0 if either is NULL."""
    return F.coalesce(a.cast("double") - b.cast("double"), F.lit(0.0))


def signed_log1p(x: Column) -> Column:
    return F.signum(x.cast("double")) * F.log1p(F.abs(x.cast("double")))


def missing_as(x: Column, default: str) -> Column:
    """x, or the default where x is NULL or empty."""
    return F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit(default))


def int_or_null(x: Column) -> Column:
    return x.try_cast("int")


def hash_bucket(seed: Column | int, key: Column) -> Column:
    """Position of (seed, key) in [0, 1]: the first 32 bits of sha256("seed:key") over 0xFFFFFFFF."""
    seed = F.lit(seed) if not isinstance(seed, Column) else seed
    digest = F.sha2(F.concat_ws(":", seed.cast("string"), key.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def split_name(bucket: Column, train: float = 0.90, validation: float = 0.05) -> Column:
    """train, validation or test; the upper border of validation is the float sum of both ratios."""
    return F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test")


def key_label(raw_key: Column) -> Column:
    """The character of a printable ASCII code, else keycode_N."""
    return F.when(raw_key.between(32, 126), F.char(raw_key)).otherwise(F.concat(F.lit("keycode_"), raw_key.cast("string")))


def depth_bucket(depth: Column) -> Column:
    d = int_or_null(depth)
    return F.when(d.isNull(), "unknown").when(d <= 1, "1").when(d <= 3, "2-3").when(d <= 6, "4-6").otherwise("7+")


def int_list(text: Column) -> Column:
    """Integers of a comma-separated text, blanks skipped; NULL entries where one is no integer."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: x.try_cast("int"))


def name_list(text: Column, known: list[str]) -> Column:
    """Distinct names of a comma-separated text, in order; an unknown one or none at all is an error."""
    names = F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))
    unknown = F.array_except(names, F.array(*map(F.lit, known)))
    return F.when((F.size(names) > 0) & (F.size(unknown) == 0), names).otherwise(F.raise_error(F.concat(F.lit("unknown or no names: "), text)))


def horizon_list(text: Column) -> Column:
    """Positive integers of a comma-separated text; anything else in it, or none at all, is an error."""
    values = int_list(text)
    good = (F.size(values) > 0) & F.forall(values, lambda x: F.coalesce(x > 0, F.lit(False)))
    return F.when(good, values).otherwise(F.raise_error(F.concat(F.lit("horizons must be positive integers: "), text)))


def first_present(*values: Column) -> Column:
    """The first value that is neither NULL nor an empty text."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])


def action_name(kind: Column, name: Column) -> Column:
    """Kind.NAME, or the kind alone where there is no name."""
    return F.when(name.isNull(), kind).otherwise(F.concat_ws(".", kind, name))


def list_text(values: Column) -> Column:
    """[1, 2, 3]"""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: x.cast("string")), ", "), F.lit("]"))


def action_text(action_id: Column) -> Column:
    return F.when(action_id.isNotNull(), F.format_string('{"action_id": %d}', action_id))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def element(values: Column, index: int) -> Column:
    """The element at a 0-based index, NULL outside."""
    return F.get(values, F.lit(index))
