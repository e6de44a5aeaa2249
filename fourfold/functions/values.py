"""Column builders with the value semantics of the engine: kinds, ordering, numbers and text, dates.

Kinds are null < numbers < text < blob; fields are never coerced; arithmetic on integers promotes to real on overflow; a division by zero and a
NaN are null; text functions fold ASCII only. A vector reads as the little-endian bytes of its float32 values.
"""

from __future__ import annotations

import math
import re
from decimal import ROUND_HALF_UP, Context, Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The order of kinds in comparisons and sorts.
KIND_ORDER = {"null": 0, "integer": 1, "real": 1, "text": 2, "blob": 3}
_INT = r"^[ \t\n\x0b\f\r]*([+-]?[0-9]+)"
_REAL = r"^[ \t\n\x0b\f\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def kind_of(data_type: T.DataType) -> str:
    """The kind that values of a Spark type have."""
    if isinstance(data_type, T.NullType):
        return "null"
    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        return "integer"
    if isinstance(data_type, (T.FractionalType,)):
        return "real"
    if isinstance(data_type, (T.BinaryType, T.ArrayType)):
        return "blob"
    return "text"


def finite(x: Column) -> Column:
    """NaN becomes null; infinities stay."""
    return F.when(~F.isnan(x), x)


def real(x: Column) -> Column:
    return x.cast("double")


def add(a: Column, b: Column, how: str, integers: bool) -> Column:
    """a + b, a - b or a * b; integer results that overflow are given as reals only in a real column, see ``promotes``."""
    if integers:
        op = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[how]
        return op(a.cast("long"), b.cast("long"))
    x, y = real(a), real(b)
    return finite({"+": x + y, "-": x - y, "*": x * y}[how])


def promoted(a: Column, b: Column, how: str) -> Column:
    """Integer arithmetic as a real column: the exact result, or the real one where it overflows."""
    exact = add(a, b, how, True)
    x, y = real(a), real(b)
    return F.coalesce(real(exact), {"+": x + y, "-": x - y, "*": x * y}[how])


def divide(a: Column, b: Column, integers: bool) -> Column:
    """Integers truncate toward zero; anything by zero is null."""
    if integers:
        a, b = a.cast("long"), b.cast("long")
        return F.when(b != 0, F.when(b == -1, F.try_subtract(F.lit(0).cast("long"), a)).otherwise((a - F.try_mod(a, b)) / F.when(b != 0, b)).cast("long"))
    return finite(F.try_divide(real(a), real(b)))


def modulo(a: Column, b: Column, integers: bool) -> Column:
    """The sign of the left; reals are truncated to integers first and give a real."""
    rest = F.try_mod(a.cast("long"), b.cast("long"))
    return rest if integers else real(rest)


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def ascii_upper(x: Column) -> Column:
    return F.translate(x, LOWER, UPPER)


def like(x: Column, pattern: Column, escape: str | None = None) -> Column:
    """LIKE that ignores the case of ASCII letters only; a pattern may hold backslashes."""
    fold = ascii_lower(pattern)
    if escape is None:
        return F.like(ascii_lower(x), F.replace(fold, F.lit("\\"), F.lit("\\\\")))
    return F.like(ascii_lower(x), fold, F.lit(escape.lower()))


def cast_integer(x: Column, kind: str) -> Column:
    """Text by its longest integer prefix, 0 if none; reals truncated and clamped to 64 bits."""
    if kind == "integer":
        return x.cast("long")
    if kind == "real":
        return F.when(x >= 9.223372036854775807e18, F.lit((1 << 63) - 1)).when(x <= -9.223372036854775808e18, F.lit(-(1 << 63) + 1) - 1).otherwise(F.when(~F.isnan(x), F.when(F.abs(x) < 9.2e18, x).otherwise(0.0)).cast("long"))
    digits = F.regexp_extract(x.cast("string"), _INT, 1)
    number = digits.try_cast("long")
    big = F.when(F.startswith(digits, F.lit("-")), F.lit(-(1 << 63) + 1) - 1).otherwise(F.lit((1 << 63) - 1))
    return F.when(x.isNotNull(), F.when(digits == "", F.lit(0).cast("long")).otherwise(F.coalesce(number, big)))


def cast_real(x: Column, kind: str) -> Column:
    """Text by its longest number prefix, 0.0 if none."""
    if kind in ("integer", "real"):
        return real(x)
    digits = F.regexp_extract(x.cast("string"), _REAL, 1)
    return F.when(x.isNotNull(), F.coalesce(digits.try_cast("double"), F.lit(0.0)))


def real_text(value: float | None) -> str | None:
    """A real as text: 15 significant digits where they read back equal, else 17; always with a point or an exponent form."""
    if value is None or math.isnan(value):
        return None
    if math.isinf(value):
        return "Inf" if value > 0 else "-Inf"
    if value == 0:
        return "0.0"
    digits = f"{value:.15g}"
    if float(digits) != value:
        digits = f"{value:.17g}"
    mantissa, _, exponent = digits.partition("e")
    if "." not in mantissa:
        mantissa += ".0"
    return f"{mantissa}e{int(exponent):+03d}" if exponent else mantissa


def text(x: Column, kind: str) -> Column:
    """Any value as text; reals go through an Arrow UDF because their rendering is not Spark's."""
    if kind == "real":
        return real_text_udf()(real(x))
    return x.cast("string")


def real_text_udf():
    """``real_text`` over Arrow batches."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def render(x: pa.Array) -> pa.Array:
        return pa.array([real_text(v) for v in x.to_pylist()], pa.string())

    return render


def decimal_round(value: float | None, places: int | None) -> float | None:
    """Half away from zero; at 1 place and more the exact binary value, rounded in decimal."""
    if value is None or places is None:
        return None
    places = max(0, min(30, places))
    if not math.isfinite(value) or abs(value) >= 2**52:
        return value
    if places == 0:
        return float(math.copysign(math.floor(abs(value) + 0.5), value))
    return float(Decimal(value).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP, Context(prec=400)))


def round_(x: Column, places: Column | None = None) -> Column:
    return F.round(real(x)).cast("double") if places is None else round_udf()(real(x), places.cast("long"))


def round_udf():
    """``decimal_round`` over Arrow batches."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def rounded(v: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([decimal_round(a, b) for a, b in zip(v.to_pylist(), n.to_pylist())], pa.float64())

    return rounded


def substr(x: Column, start: Column, length: Column | None = None) -> Column:
    """1-based; a negative start counts from the end; a negative length takes what lies before; 0 lies before the first."""
    n = F.length(x).cast("long")
    start = start.cast("long")
    first = F.when(start > 0, start - 1).when(start < 0, n + start).otherwise(F.lit(-1).cast("long"))
    if length is None:
        lo, hi = F.when(start == 0, 0).otherwise(first), n
        lo = F.greatest(lo, F.lit(0).cast("long"))
    else:
        length = length.cast("long")
        lo = F.when(length >= 0, first).otherwise(F.when(start == 0, F.lit(0)).otherwise(first) + length)
        hi = F.when(length >= 0, first + length).otherwise(F.when(start == 0, F.lit(0)).otherwise(first))
        lo, hi = F.greatest(lo, F.lit(0).cast("long")), F.least(hi, n)
    return F.when(x.isNotNull() & lo.isNotNull() & hi.isNotNull(), F.substring(x, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0).cast("long")).cast("int")))


def scalar_extreme(columns: list[Column], largest: bool) -> Column:
    """max(x, y, ...) and min(x, y, ...): null if any is null."""
    pick = (F.greatest if largest else F.least)(*columns)
    known = columns[0].isNotNull()
    for c in columns[1:]:
        known = known & c.isNotNull()
    return F.when(known, pick)


def typeof(x: Column, kind: str) -> Column:
    return F.when(x.isNull(), F.lit("null")).otherwise(F.lit(kind))


def length(x: Column, kind: str) -> Column:
    """Characters before the first NUL, bytes of a blob, digits of a number's text."""
    if kind == "blob":
        return F.octet_length(x).cast("long")
    return F.length(F.substring_index(text(x, kind), "\0", 1)).cast("long")


_MODIFIER = re.compile(r"^\s*([+-]?\d+)\s+(day|month|year)s?\s*$", re.I)


def shift_date(day: Column, modifiers: list[str]) -> Column:
    """Whole days, months and years added in turn; a day past a month's end runs on into the next month."""
    for m in modifiers:
        found = _MODIFIER.match(m)
        if not found:
            raise ValueError(f"unknown modifier {m!r}")
        n, unit = int(found[1]), found[2].lower()
        if unit == "day":
            day = F.date_add(day, n)
        else:
            months = F.year(day) * 12 + F.month(day) - 1 + n * (12 if unit == "year" else 1)
            day = F.date_add(F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1)), F.dayofmonth(day) - 1)
    return day
