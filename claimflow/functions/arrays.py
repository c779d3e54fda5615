"""Array helpers built from Spark higher-order functions (no Python UDF).

Note on cost: an expression referenced *inside* a lambda is re-evaluated
for every element, while the arguments of a higher-order function are
evaluated once per row. ``let`` binds a computed value to a lambda variable,
so a value used in several places is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The least elements of a block of prefix sums.
BLOCK = 32


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0).cast("bigint"), lambda a, x: a + x)


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def exclusive_prefix_sums(arr: Column) -> Column:
    """``out[i] = arr[0] + ... + arr[i-1]`` for an integer array.

    Spark has no array scan, and summing the slice before every element is
    O(n^2). Here the array is cut into blocks of n^(1/3) elements, ``BLOCK`` at
    least: block sums are carried by one ``aggregate`` and each block's own
    prefixes are short, for O(n^(4/3)) overall. A short array is one block.
    """
    def blocked(a: Column) -> Column:
        return let(F.greatest(F.lit(BLOCK), F.ceil(F.cbrt(F.size(a))).cast("int")), lambda b: let(F.transform(
            F.sequence(F.lit(0), F.ceil(F.size(a) / b).cast("int") - 1), lambda j: F.slice(a, j * b + 1, b)), summed))

    def summed(blocks: Column) -> Column:
        init = F.struct(F.lit(0).cast("bigint").alias("run"), F.array().cast("array<bigint>").alias("out"))
        bases = F.aggregate(
            F.transform(blocks, array_sum), init,
            lambda acc, x: F.struct((acc["run"] + x).alias("run"), F.array_append(acc["out"], acc["run"]).alias("out")),
            lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, bases, lambda blk, base: F.transform(
            blk, lambda x, i: base + array_sum(F.slice(blk, 1, i)))))

    return F.when(F.size(arr) == 0, F.array().cast("array<bigint>")).otherwise(let(arr, blocked))


def interleave(a: Column, b: Column) -> Column:
    """``[a0, b0, a1, b1, ...]``; when ``a`` is one longer, its last element ends
    the result. Elements must be non-null."""
    return F.filter(F.flatten(F.zip_with(a, b, lambda x, y: F.array(x, y))), lambda v: v.isNotNull())
