"""The 64-bit mixing hash as a Spark expression, wrapping where Spark's + would raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = 0xFFFFFFFF


def wrapping_add(a: Column, b: Column) -> Column:
    """a + b modulo 2**64, in two 32-bit halves."""
    low = a.bitwiseAND(F.lit(_LOW)) + b.bitwiseAND(F.lit(_LOW))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


#: fixed values: the mixing steps, as (kind, shift); a left shift is added, inverted or not, a right shift is xored
STEPS = (("add_not", 32), ("xor", 22), ("add_not", 13), ("xor", 8), ("add", 3), ("xor", 15), ("add_not", 27), ("xor", 31))


def hash_64(key: Column) -> Column:
    """A BIGINT's hash, as a BIGINT; null gives null."""
    x = key.cast("long")
    for kind, n in STEPS:
        if kind == "xor":
            x = x.bitwiseXOR(F.shiftrightunsigned(x, n))
        else:
            shifted = F.shiftleft(x, n)
            x = wrapping_add(x, F.bitwise_not(shifted) if kind == "add_not" else shifted)
    return x


def hash_64_table(df, key: str, name: str = "hash"):
    """df with the hash of a column, one column a step so that no step is written out twice."""
    out = df.withColumn(name, F.col(key).cast("long"))
    for kind, n in STEPS:
        x = F.col(name)
        if kind == "xor":
            step = x.bitwiseXOR(F.shiftrightunsigned(x, n))
        else:
            step = wrapping_add(x, F.bitwise_not(F.shiftleft(x, n)) if kind == "add_not" else F.shiftleft(x, n))
        out = out.withColumn(name, step)
    return out
