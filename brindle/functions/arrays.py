"""Array functions with PostgreSQL semantics.  Arrays are counted from 1; other lower bounds don't exist here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.base import col, fail_if, val


def array_append(a, x):
    return F.array_append(F.coalesce(col(a), F.array()), val(x))


def array_prepend(x, a):
    return F.array_prepend(F.coalesce(col(a), F.array()), val(x))


def array_cat(a, b):
    """Both in a row; null is like an empty array, unless both are null."""
    a, b = col(a), val(b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


def array_dims(a):
    a = col(a)
    return F.when(F.size(a) > 0, F.concat(F.lit("[1:"), F.size(a).cast("string"), F.lit("]")))


def array_ndims(a, depth: int = 1):
    """Dimensions, by the type's nesting; null for the empty array."""
    return F.when(F.size(col(a)) > 0, F.lit(depth))


def array_length(a, dimension: int = 1):
    """Length, null for the empty array or another dimension."""
    a = col(a)
    for _ in range(1, dimension):
        a = F.try_element_at(a, F.lit(1))
    return F.when(F.size(a) > 0, F.size(a)) if dimension >= 1 else F.lit(None).cast("int")


array_upper = array_length


def array_lower(a, dimension: int = 1):
    return F.when(array_length(a, dimension).isNotNull(), F.lit(1))


def cardinality(a, depth: int = 1):
    """All elements of all dimensions."""
    a = col(a)
    for _ in range(1, depth):
        a = F.flatten(a)
    return F.size(a)


def array_fill(x, *lengths):
    out = val(x)
    for n in reversed(lengths):
        out = F.array_repeat(out, n)
    return out


def array_position(a, x, start=1):
    """First place of an element, null too, from a place on; null if there is none."""
    a, x = col(a), val(x)
    places = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: (i >= val(start)) & F.try_element_at(a, i).eqNullSafe(x))
    return F.when(F.size(a) > 0, F.try_element_at(places, F.lit(1)))


def array_positions(a, x):
    a, x = col(a), val(x)
    places = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: F.try_element_at(a, i).eqNullSafe(x))
    return F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(places)


def array_remove(a, x):
    return F.filter(col(a), lambda y: ~y.eqNullSafe(val(x)))


def array_replace(a, old, new):
    return F.transform(col(a), lambda y: F.when(y.eqNullSafe(val(old)), val(new)).otherwise(y))


def array_reverse(a):
    return F.reverse(col(a))


def array_sort(a, descending: bool = False, nulls_first: bool | None = None):
    """Sorted; nulls are the largest values unless told."""
    a = col(a)
    first = descending if nulls_first is None else nulls_first
    known = F.filter(a, lambda x: x.isNotNull())
    none = F.filter(a, lambda x: x.isNull())
    known = F.sort_array(known, asc=not descending)
    return F.concat(none, known) if first else F.concat(known, none)


def array_shuffle(a, seed: int | None = None):
    return F.shuffle(col(a), seed) if seed is not None else F.shuffle(col(a))


def array_sample(a, n, seed: int | None = None):
    a = col(a)
    return fail_if((val(n) < 0) | (val(n) > F.size(a)), "sample size must be between 0 and the array's length", F.slice(array_shuffle(a, seed), 1, val(n)))


def array_to_string(a, separator: str, null_string: str | None = None):
    return F.array_join(F.transform(col(a), lambda x: x.cast("string")), separator, null_string)


def arraycontains(a, b):
    """The operator @>: every element of b is one of a; a null element of b is in no array."""
    a, b = col(a), val(b)
    return F.forall(b, lambda x: F.coalesce(F.exists(a, lambda y: y == x), F.lit(False)))


def arraycontained(a, b):
    return arraycontains(val(b), col(a))


def arrayoverlap(a, b):
    """The operator &&: some element that isn't null is in both."""
    return F.coalesce(F.arrays_overlap(F.filter(col(a), lambda x: x.isNotNull()), F.filter(val(b), lambda x: x.isNotNull())), F.lit(False))


def array_eq(a, b):
    return col(a).eqNullSafe(val(b))


def trim_array(a, n):
    a, n = col(a), val(n)
    return fail_if((n < 0) | (n > F.size(a)), "number of elements to trim must be between 0 and the array's length", F.slice(a, F.lit(1), F.size(a) - n))


def subscript(a, i):
    """a[i]; null outside."""
    a, i = col(a), val(i)
    return F.when(i >= 1, F.try_element_at(a, F.when(i >= 1, i).otherwise(1)))


def slice_of(a, low=None, high=None):
    """a[low:high], each end by default the array's."""
    a = col(a)
    low = F.greatest(val(low), F.lit(1)) if low is not None else F.lit(1)
    high = F.least(val(high), F.size(a)) if high is not None else F.size(a)
    return F.slice(a, low, F.greatest(high - low + 1, F.lit(0)))


def any_equal(x, a) -> Column:
    """x = ANY (a), in three-valued logic."""
    return F.exists(val(a), lambda y: y == val(x))


def all_equal(x, a) -> Column:
    return F.forall(val(a), lambda y: y == val(x))
