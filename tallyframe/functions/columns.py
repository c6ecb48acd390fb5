"""Column-level helpers built only from ``pyspark.sql.functions``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python's str.split()/str.strip() whitespace set, written so that both the
# Java and the RE2 regex dialects accept it.
WS_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_flat(dt: T.DataType) -> bool:
    return not isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def numeric_columns(df: DataFrame) -> list[str]:
    """Value-capable columns: numeric, not boolean."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_string(f.dataType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value everywhere in this library; it becomes NULL
    once, where data come in (a projection; other columns are untouched)."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    if not floats:
        return df
    return df.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def strip_ws(c: Column) -> Column:
    """``str.strip()`` on a string column."""
    return F.regexp_replace(c, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def split_words(c: Column) -> Column:
    """``str.split()``: whitespace runs, no empty words."""
    stripped = strip_ws(c)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, f"{WS_CLASS}+"))


def unbiased_skew(c: Column | str) -> Column:
    """Bias-corrected sample skewness G1 (NULL below three values)."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole, NULL when whole is 0 or NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)


def round_half_up(c: Column, digits: int = 4) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d`` - plain IEEE arithmetic, so every
    engine that evaluates the same formula gets the same bits (the built-in
    ``round`` functions disagree on decimal ties such as 0.18875)."""
    scale = 10 ** digits
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(x * scale + 0.5) / scale)


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double/float column (for engine-independent comparison)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half_up(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def money_sum(c: Column, scale: int | None) -> Column:
    """Sum that does not depend on row order when ``scale`` is given.

    Values with at most ``scale`` decimals are added as whole units of
    10^-scale in BIGINT (exact, so identical on any partitioning, and kept in
    the long-arithmetic code path; DECIMAL(38, s) sums go through BigDecimal
    objects).  The result is converted back to double once, at the end.
    """
    if scale is None:
        return F.sum(c)
    unit = 10 ** scale
    return F.sum(F.round(c.cast("double") * unit).cast("bigint")).cast("double") / float(unit)


# Text formatting of numbers (Python format specs re-expressed; the value is
# rounded half-up in IEEE arithmetic first so every formatter agrees).

def fmt_fixed(c: Column, digits: int = 1, sign: bool = False) -> Column:
    """``f"{x:.{d}f}"`` (``+`` with ``sign``)."""
    return F.format_string(("%+." if sign else "%.") + f"{digits}f", round_half_up(c, digits))


def fmt_thousands(c: Column, digits: int = 0) -> Column:
    """``f"{x:,.{d}f}"``."""
    return F.format_number(round_half_up(c, digits), digits)


def fmt_repr(c: Column, digits: int) -> Column:
    """``str(round(x, d))`` for values below 1e7."""
    return round_half_up(c, digits).cast("string")
