"""Vectors as arrays of floats; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.base import col, fail_if, val


def _doubles(a) -> Column:
    return col(a).cast("array<double>") if not isinstance(a, (list, tuple)) else F.array(*(F.lit(float(x)) for x in a))


def _pair(a, b):
    a, b = _doubles(a), _doubles(b)
    return fail_if(F.size(a) != F.size(b), "different vector dimensions", a), b


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def inner_product(a, b):
    a, b = _pair(a, b)
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def negative_inner_product(a, b):
    """The operator <#>."""
    return -inner_product(a, b)


def l2_squared_distance(a, b):
    a, b = _pair(a, b)
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2_distance(a, b):
    """The operator <->."""
    return F.sqrt(l2_squared_distance(a, b))


def l1_distance(a, b):
    """The operator <+>."""
    a, b = _pair(a, b)
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def vector_norm(a):
    return F.sqrt(_sum(F.transform(_doubles(a), lambda x: x * x)))


def cosine_distance(a, b):
    """The operator <=>; NaN if either is zero."""
    similarity = inner_product(a, b) / F.nullif(vector_norm(a) * vector_norm(b), F.lit(0.0))
    return F.coalesce(1 - F.greatest(F.least(similarity, F.lit(1.0)), F.lit(-1.0)), F.lit(float("nan")))


def spherical_distance(a, b):
    return F.acos(F.greatest(F.least(inner_product(a, b), F.lit(1.0)), F.lit(-1.0))) / F.pi()


def vector_add(a, b):
    a, b = _pair(a, b)
    return F.zip_with(a, b, lambda x, y: x + y)


def vector_sub(a, b):
    a, b = _pair(a, b)
    return F.zip_with(a, b, lambda x, y: x - y)


def vector_mul(a, b):
    a, b = _pair(a, b)
    return F.zip_with(a, b, lambda x, y: x * y)


def vector_concat(a, b):
    return F.concat(_doubles(a), _doubles(b))


def vector_dims(a):
    return F.size(col(a))


def subvector(a, start, count):
    """From a place counted from 1; what lies before the vector counts but holds nothing."""
    a, start, count = _doubles(a), val(start), val(count)
    low = F.greatest(start, F.lit(1))
    high = F.least(start + count - 1, F.size(a))
    return fail_if((count < 1) | (high < low), "vector must have at least 1 dimension", F.slice(a, low, F.greatest(high - low + 1, F.lit(1))))


def l2_normalize(a):
    a = _doubles(a)
    norm = vector_norm(a)
    return F.transform(a, lambda x: F.when(norm == 0, 0.0).otherwise(x / norm))


def binary_quantize(a):
    """Bits as text: 1 where the vector is positive."""
    return F.array_join(F.transform(col(a), lambda x: F.when(x > 0, "1").otherwise("0")), "")


def _bits(a) -> Column:
    return F.filter(F.split(val(a), ""), lambda x: x != "")


def hamming_distance(a, b):
    """The operator <~> between bits as text."""
    return _sum(F.zip_with(_bits(a), _bits(b), lambda x, y: F.when(x == y, 0.0).otherwise(1.0)))


def jaccard_distance(a, b):
    """The operator <%> between bits as text."""
    both = _sum(F.zip_with(_bits(a), _bits(b), lambda x, y: F.when((x == "1") & (y == "1"), 1.0).otherwise(0.0)))
    any_ = _sum(F.zip_with(_bits(a), _bits(b), lambda x, y: F.when((x == "1") | (y == "1"), 1.0).otherwise(0.0)))
    return F.when(both == 0, 1.0).otherwise(1 - both / any_)


def vector_aggregate(df: DataFrame, keys: list[str], vector: str, how: str, out: str) -> DataFrame:
    """Sum or avg of vectors by group, element by element, pre-aggregated before the shuffle."""
    each = df.select(*keys, F.posexplode(_doubles(vector)).alias("at", "x"))
    part = each.groupBy(*keys, "at").agg({"sum": F.sum, "avg": F.avg}[how]("x").alias("x"))
    grouped = part.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    return grouped.select(*keys, F.transform("v", lambda e: e["x"]).alias(out))


def nearest(df: DataFrame, vector: str, query: list[float], k: int, distance=l2_distance, out: str = "distance") -> DataFrame:
    """The k rows nearest to one vector: a top-k over a scan, so only k rows a task are sorted and sent."""
    return df.withColumn(out, distance(F.col(vector), query)).orderBy(F.col(out).asc_nulls_last()).limit(k)


def array_to_vector(a, dims: int | None = None):
    """An array as a vector; another number of dimensions, a null or something infinite raises."""
    a = _doubles(a)
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | F.abs(x).eqNullSafe(float("inf"))) | (F.size(a) == 0)
    if dims is not None:
        bad = bad | (F.size(a) != dims)
    return fail_if(bad, "not a vector of that many dimensions", a.cast("array<float>"))


def vector_to_float4(a):
    return col(a).cast("array<float>")


def vector_accum(state, v):
    """A state of count and sums, with one vector more."""
    state, v = col(state), _doubles(v)
    first = F.concat(F.array(F.lit(1.0)), v)
    more = F.concat(F.array(state[0] + 1), F.zip_with(F.slice(state, 2, F.greatest(F.size(state) - 1, F.lit(0))), v, lambda a, b: a + b))
    return F.when(F.size(state) <= 1, first).otherwise(more)


def vector_combine(a, b):
    """Two such states as one."""
    a, b = col(a), col(b)
    return F.when(F.size(a) <= 1, b).when(F.size(b) <= 1, a).otherwise(F.zip_with(a, b, lambda x, y: x + y))


def vector_avg(state):
    state = col(state)
    return F.when(F.size(state) > 1, F.transform(F.slice(state, 2, F.greatest(F.size(state) - 1, F.lit(1))), lambda x: x / state[0]))
