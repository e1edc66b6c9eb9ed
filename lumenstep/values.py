"""Missing-value, comparison and coercion rules of data-step values, as Column helpers.

NULL is the ordinary missing value. It sorts before every number, equals itself, and counts as false. Trailing blanks
of character values don't matter in comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = "1960-01-01"


def col(x) -> Column:
    """A Column from a column name or a Column; other Python values become literals through lit()."""
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def is_missing(x: Column, char: bool = False) -> Column:
    return (x.isNull() | (F.trim(x) == "")) if char else (x.isNull() | F.isnan(x.cast("double")))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x.cast("double")), x)


def truth(x: Column) -> Column:
    """Missing and zero are false."""
    return F.coalesce(x.cast("double") != 0, F.lit(False))


def eq(a: Column, b: Column, char: bool = False) -> Column:
    return F.rtrim(a).eqNullSafe(F.rtrim(b)) if char else a.eqNullSafe(b)


def lt(a: Column, b: Column, char: bool = False) -> Column:
    """a < b in the total order with missing first."""
    if char:
        a, b = F.rtrim(a), F.rtrim(b)
    return F.coalesce(a < b, a.isNull() & b.isNotNull())


def le(a: Column, b: Column, char: bool = False) -> Column:
    return lt(a, b, char) | eq(a, b, char)


def gt(a: Column, b: Column, char: bool = False) -> Column:
    return lt(b, a, char)


def ge(a: Column, b: Column, char: bool = False) -> Column:
    return le(b, a, char)


def ne(a: Column, b: Column, char: bool = False) -> Column:
    return ~eq(a, b, char)


def isin(x: Column, *values) -> Column:
    """Membership with null-safe equality."""
    out = F.lit(False)
    for v in values:
        out = out | x.eqNullSafe(F.lit(v))
    return out


def divide(a: Column, b: Column) -> Column:
    """Division by zero is missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def power(a: Column, b: Column) -> Column:
    """A negative base with a fractional exponent is missing, and so is zero with a negative one."""
    bad = ((a < 0) & (b != F.floor(b))) | ((a == 0) & (b < 0))
    return F.when(~bad, F.pow(a, b))


def to_number(c: Column) -> Column:
    """Character to number; text that is no number is missing."""
    return F.expr("try_cast(x AS double)") if c is None else F.trim(c).try_cast("double")


def concat(*cols: Column) -> Column:
    """|| : missing text is empty, numbers take twelve places, right-justified, when wrapped in best12()."""
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def date_number(c: Column) -> Column:
    """Days since 1960-01-01."""
    return F.datediff(c, F.lit(EPOCH).cast("date"))


def number_date(c: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), c.cast("int"))


def datetime_number(c: Column) -> Column:
    """Seconds since 1960-01-01."""
    return F.unix_seconds(c.cast("timestamp")) + 3653 * 86400


def nulls_like(df: DataFrame, name: str) -> Column:
    return F.lit(None).cast(df.schema[name].dataType)


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def with_metadata(df: DataFrame, name: str, **items) -> DataFrame:
    """Declarative attributes (length, format, informat, label) on a column; they survive Parquet."""
    field = df.schema[name]
    merged = {**(field.metadata or {}), **{k: v for k, v in items.items() if v is not None}}
    c = F.col(name)
    if items.get("length") and isinstance(field.dataType, T.StringType):
        c = F.substring(c, 1, int(items["length"]))
    return df.withColumn(name, c.alias(name, metadata=merged))
