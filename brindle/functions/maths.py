"""Mathematical functions with PostgreSQL semantics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.base import col, fail_if, val


def _domain(x, ok, f):
    x = col(x).cast("double")
    return fail_if(~ok(x), "input is out of range", f(x))


def acos(x):
    return _domain(x, lambda x: x.between(-1, 1), F.acos)


def asin(x):
    return _domain(x, lambda x: x.between(-1, 1), F.asin)


def acosd(x):
    return F.degrees(acos(x))


def asind(x):
    return F.degrees(asin(x))


def acosh(x):
    return _domain(x, lambda x: x >= 1, F.acosh)


def atanh(x):
    return _domain(x, lambda x: x.between(-1, 1), F.atanh)


def atand(x):
    return F.degrees(F.atan(col(x)))


def atan2d(y, x):
    return F.degrees(F.atan2(val(y), val(x)))


def cosd(x):
    return F.cos(F.radians(col(x)))


def sind(x):
    return F.sin(F.radians(col(x)))


def tand(x):
    return F.tan(F.radians(col(x)))


def cotd(x):
    return F.cot(F.radians(col(x)))


def _plain(f):
    def function(x):
        return f(col(x))

    return function


abs, asinh, atan, cbrt, cos, cosh, cot, degrees, exp, radians, sign, sin, sinh, tan, tanh = (
    _plain(f) for f in (F.abs, F.asinh, F.atan, F.cbrt, F.cos, F.cosh, F.cot, F.degrees, F.exp, F.radians, F.sign, F.sin, F.sinh, F.tan, F.tanh)
)
ceil = ceiling = _plain(F.ceil)
floor = _plain(F.floor)


def atan2(y, x):
    return F.atan2(val(y), val(x))


def sqrt(x):
    x = col(x)
    return fail_if(x < 0, "cannot take square root of a negative number", F.sqrt(x))


def ln(x):
    x = col(x)
    return fail_if(x == 0, "cannot take logarithm of zero", fail_if(x < 0, "cannot take logarithm of a negative number", F.ln(x)))


def log(a, b=None):
    """Base 10 with one argument; base and number with two."""
    a = val(a) if b is not None else col(a)
    x = a if b is None else val(b)
    found = F.log10(x) if b is None else F.ln(x) / F.ln(a)
    return fail_if(x <= 0, "cannot take logarithm of a number that is not positive", found)


def log10(x):
    return log(x)


def power(a, b):
    a, b = val(a), val(b)
    return fail_if((a == 0) & (b < 0), "zero raised to a negative power is undefined", fail_if((a < 0) & (b != F.floor(b)), "a negative number raised to a non-integer power yields a complex result", F.power(a, b)))


pow = power


def div(a, b):
    """Quotient of numerics towards zero."""
    q = val(a) / val(b)
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q))


def int_divide(a, b):
    """The operator / between integers: it truncates, and division by zero raises."""
    return F.expr("NULL") if a is None or b is None else F.call_function("div", val(a), val(b))


def mod(a, b):
    return val(a) % val(b)


def factorial(n):
    """Exact for every n, as text of the digits past 20! as a decimal up to 33!."""
    n = col(n)
    return fail_if(n < 0, "factorial of a negative number is undefined", _factorial(n))


@F.pandas_udf(T.DecimalType(38, 0))
def _factorial(n: pd.Series) -> pd.Series:
    from decimal import Decimal

    return n.map(lambda x: None if pd.isna(x) else Decimal(math.factorial(int(x))))


@F.pandas_udf(T.DoubleType())
def _gamma(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else math.gamma(v))


@F.pandas_udf(T.DoubleType())
def _lgamma(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else math.lgamma(v))


def gamma(x):
    return _gamma(col(x).cast("double"))


def lgamma(x):
    return _lgamma(col(x).cast("double"))


@F.pandas_udf(T.LongType())
def _gcd(a: pd.Series, b: pd.Series) -> pd.Series:
    none = a.isna() | b.isna()
    return pd.Series(np.gcd(a.fillna(0).astype("int64"), b.fillna(0).astype("int64")), dtype="Int64").mask(none)


@F.pandas_udf(T.LongType())
def _lcm(a: pd.Series, b: pd.Series) -> pd.Series:
    none = a.isna() | b.isna()
    return pd.Series(np.lcm(a.fillna(0).astype("int64"), b.fillna(0).astype("int64")), dtype="Int64").mask(none)


def gcd(a, b):
    return _gcd(val(a).cast("long"), val(b).cast("long"))


def lcm(a, b):
    return _lcm(val(a).cast("long"), val(b).cast("long"))


def greatest(*args):
    return F.greatest(*map(val, args))


def least(*args):
    return F.least(*map(val, args))


def num_nulls(*args):
    return sum((F.isnull(val(a)).cast("int") for a in args), F.lit(0))


def num_nonnulls(*args):
    return sum((F.isnotnull(val(a)).cast("int") for a in args), F.lit(0))


def _digits(x: Column) -> Column:
    return F.regexp_extract(x.cast("string"), r"\.(\d+)$", 1)


def scale(x):
    """Digits behind the point of a numeric."""
    return F.length(_digits(col(x)))


def min_scale(x):
    return F.length(F.rtrim(_digits(col(x)), F.lit("0")))


def trim_scale(x):
    """Text of a numeric without zeros at its end."""
    text = col(x).cast("string")
    return F.when(F.contains(text, F.lit(".")), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def pi():
    return F.pi()


def random(low=None, high=None, seed: int | None = None):
    r = F.rand(seed) if seed is not None else F.rand()
    return r if low is None else val(low) + r * (val(high) - val(low))


def random_normal(mean=0.0, deviation=1.0, seed: int | None = None):
    r = F.randn(seed) if seed is not None else F.randn()
    return val(mean) + r * val(deviation)


def round_double(x):
    """round() of a double: halves go to the even neighbour."""
    return F.rint(col(x))


def round(x, places: int = 0):
    """round() of a numeric: halves go away from zero."""
    return F.round(col(x), places)


def trunc(x, places: int = 0):
    x = col(x)
    scaled = x * F.lit(10**places) if places else x
    cut = F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled))
    return cut / F.lit(10**places) if places else cut


def width_bucket(x, low, high, n):
    """Which of n equal bins between two bounds; 0 below, n + 1 above.  Bounds may fall."""
    x, low, high, n = col(x), val(low), val(high), val(n)
    found = F.width_bucket(x.cast("double"), low.cast("double"), high.cast("double"), n)
    return fail_if(low == high, "lower bound cannot equal upper bound", fail_if(n <= 0, "count must be greater than zero", found)).cast("int")


def width_bucket_of(x, bounds):
    """Which bin of rising lower bounds; 0 below the first."""
    x = col(x)
    return F.size(F.filter(val(bounds), lambda b: b <= x))


def to_int_from_double(x):
    """Cast of a double to an integer: rounds, halves to even."""
    return F.rint(col(x)).cast("long")


def to_int_from_numeric(x):
    """Cast of a numeric to an integer: rounds, halves away from zero."""
    return F.round(col(x), 0).cast("long")


def double_text(x):
    """Text of a double: whole numbers without a point, no exponent."""
    x = col(x).cast("double")
    text = lambda pattern: F.call_function("format_number", x, F.lit(pattern))
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when(x == F.rint(x), text("0")).otherwise(text("0.#################"))
