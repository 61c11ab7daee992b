"""The streams of rng.py as column expressions: xoshiro256** keyed by row, without Python workers.

Spark checks integers for overflow, so products modulo 2^64 are put together from 16-bit factors, none of whose products leaves
a long. Each step is a column of its own: Spark then computes it once, where nested expressions would be copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .rng import MASK, mix

LOW = 0xFFFFFFFF
#: The increment and the factors of the mixing function.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shifted(x: Column, by: int) -> Column:
    """x moved right, zeros coming in."""
    return F.shiftrightunsigned(x, by)


def joined(high: Column, low: Column) -> Column:
    return F.shiftleft(high.bitwiseAND(LOW), 32).bitwiseOR(low.bitwiseAND(LOW))


def plus(a: Column, c: int) -> Column:
    """a + c modulo 2^64."""
    low = a.bitwiseAND(LOW) + (c & LOW)
    return joined(shifted(a, 32) + (c >> 32) + shifted(low, 32), low)


def times(a: Column, c: int) -> Column:
    """a * c modulo 2^64."""
    low, high = a.bitwiseAND(LOW), shifted(a, 32)
    c0, c1, c2, c3 = ((c >> s) & 0xFFFF for s in (0, 16, 32, 48))
    first, second = low * c0, low * c1
    bottom = first + F.shiftleft(second.bitwiseAND(0xFFFF), 16)
    part = lambda x, even, odd: (x * even).bitwiseAND(LOW) + F.shiftleft((x * odd).bitwiseAND(0xFFFF), 16)
    return joined(shifted(bottom, 32) + shifted(second, 16) + part(low, c2, c3) + part(high, c0, c1), bottom)


def turned(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(shifted(x, 64 - by))


def mixed(df: DataFrame, name: str) -> DataFrame:
    """df with a column put through the mixing function."""
    x = F.col(name)
    for shift, factor in ((30, FIRST), (27, SECOND)):
        df = df.withColumn(name, x.bitwiseXOR(shifted(x, shift))).withColumn(name, times(x, factor))
    return df.withColumn(name, x.bitwiseXOR(shifted(x, 31)))


STATE = ("_a", "_b", "_c", "_d")


def seeded(df: DataFrame, seed: int, category: int | Column, index: Column) -> DataFrame:
    """df with the state of the stream (seed, category, index) of each row."""
    head = mix(STEP ^ (seed & LOW))
    if isinstance(category, int):
        start = F.lit(signed(mix(head ^ (category << 32))))
        df = df.withColumn("_at", index.cast("long").bitwiseXOR(start))
    else:
        df = mixed(df.withColumn("_at", F.shiftleft(category.cast("long"), 32).bitwiseXOR(F.lit(signed(head)))), "_at")
        df = df.withColumn("_at", F.col("_at").bitwiseXOR(index.cast("long")))
    df = mixed(df, "_at")
    for name in STATE:
        df = df.withColumn("_at", plus(F.col("_at"), STEP)).withColumn(name, F.col("_at"))
        df = mixed(df, name)
    return df.drop("_at")


def drawn(df: DataFrame, *names: str) -> DataFrame:
    """df with the next raw values of each row's stream, as signed longs."""
    a, b, c, d = (F.col(x) for x in STATE)
    for name in names:
        df = df.withColumn(name, times(b, 5)).withColumn(name, turned(F.col(name), 7)).withColumn(name, times(F.col(name), 9))
        df = df.withColumns({"_c": c.bitwiseXOR(a), "_d": d.bitwiseXOR(b), "_s": F.shiftleft(b, 17)})
        df = df.withColumns({"_a": a.bitwiseXOR(d), "_b": b.bitwiseXOR(c), "_c": c.bitwiseXOR(F.col("_s")), "_d": turned(d, 45)})
    return df.drop("_s")


def below(raw: Column, bound: Column | int) -> Column:
    """A value from 0 to bound - 1 of a raw one; 0 for bounds below 1. Bounds go up to 2^31."""
    bound = F.lit(bound).cast("long") if isinstance(bound, int) else bound.cast("long")
    return F.when(bound > 0, shifted(bound * shifted(raw, 32), 32)).otherwise(F.lit(0).cast("long"))


def remainder(raw: Column, by: Column) -> Column:
    """raw, as an unsigned number, modulo by (up to 2^61)."""
    return (shifted(raw, 1) % by * 2 + raw.bitwiseAND(1)) % by


#: Draws of a size that are tried in one expression; the few rows that need more go round again.
TRIES = 6


def sizes(df: DataFrame, seed: int, category: int, index: Column) -> DataFrame:
    """df (p50, p90, max) with size: log-uniform in a band below p50 (half of the draws), to p90 (four in ten) or to max, and
    drawn again while it lies beyond its band."""
    p50 = F.greatest(F.lit(1).cast("long"), F.col("p50").cast("long"))
    p90 = F.greatest(p50, F.col("p90").cast("long"))
    most = F.greatest(p90, F.col("max").cast("long"))
    df = drawn(seeded(df, seed, category, index), "_r").withColumn("_r", below(F.col("_r"), 100))
    df = df.withColumn("_low", F.when(F.col("_r") < 50, F.greatest(F.lit(1).cast("long"), shifted(p50, 1))).when(F.col("_r") < 90, p50).otherwise(p90))
    df = df.withColumn("_high", F.when(F.col("_r") < 50, p50).when(F.col("_r") < 90, p90).otherwise(most)).drop("_r")
    low, high = F.col("_low"), F.col("_high")
    # the bits of ceil(high / low) - 1: how often low may be doubled and still lie below high
    ratio = F.expr("(_high - 1) div _low")
    df = df.withColumn("_n", F.when(high > low, F.length(F.bin(ratio))).otherwise(0)).withColumn("size", F.when(high <= low, low))
    only = F.col("_n") == 1
    out = None
    while True:
        for _ in range(TRIES):
            df = drawn(df, "_x", "_y").withColumn("_start", F.call_function("shiftleft", low, below(F.col("_x"), F.col("_n")).cast("int")))
            once = low + remainder(F.col("_x"), F.greatest(high - low, F.expr("1L")))
            more = F.col("_start") + remainder(F.col("_y"), F.col("_start"))
            df = df.withColumn("size", F.coalesce("size", F.when(only, once).when(more < high, more)))
        df = written(df, "sizes")
        done, df = df.where(F.col("size").isNotNull()), df.where(F.col("size").isNull())
        out = done if out is None else out.unionByName(done)
        if not df.take(1):
            return out.drop(*STATE, "_low", "_high", "_n", "_x", "_y", "_start")
