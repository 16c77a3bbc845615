"""Simulated price paths: draws numbered by path and day, so any task makes its own without the ones before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import inverse_normal_cdf

# The generator's step between draws, its shifts and masks, and seeds of the scrambled points.
STEP, SHIFTS, LOW_BITS = 0x6D2B79F5, (15, 7, 14), (1, 61)
SCRAMBLES = (0x6D2B79F5, 0x52DCE729)
WORD = 1 << 32
#: Draws are kept this far off 0 and 1, quasi-random points this far off 0 and 1.
EDGE, POINT_EDGE = 1e-9, 1e-7
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
YEAR = 252


def product(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two numbers below 2 ** 32, which has no room in 64 bits as a whole."""
    high = (a * F.shiftrightunsigned(b, 16)).bitwiseAND(0xFFFF) * 65536
    return (a * b.bitwiseAND(0xFFFF) + high).bitwiseAND(WORD - 1)


def with_uniform(rows: DataFrame, name: str, counter: Column, seed: int) -> DataFrame:
    """Adds the generator's draw of the given number (from 0), 0 to 1. Its state is a sum of steps, so it skips to any draw."""
    s, t = f"{name}_s", f"{name}_t"
    rows = rows.withColumn(s, F.pmod(seed + (counter.cast("long") + 1) * STEP, F.lit(WORD)))
    right = lambda c, k: F.shiftrightunsigned(F.col(c), SHIFTS[k])
    rows = rows.withColumn(t, product(F.col(s).bitwiseXOR(right(s, 0)), F.col(s).bitwiseOR(F.lit(LOW_BITS[0]))))
    mixed = product(F.col(t).bitwiseXOR(right(t, 1)), F.col(t).bitwiseOR(F.lit(LOW_BITS[1])))
    rows = rows.withColumn(t, F.col(t).bitwiseXOR((F.col(t) + mixed).bitwiseAND(WORD - 1)))
    return rows.withColumn(name, F.col(t).bitwiseXOR(right(t, 2)) / float(WORD)).drop(s, t)


def normal(draw: str) -> Column:
    return inverse_normal_cdf(F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), F.col(draw))))


def path_ends(rows: DataFrame, paths: int = 2000, days: int = 20, seed: int = 12345) -> DataFrame:
    """key, path, return_pct: where each path of geometric Brownian motion ends. rows: key, drift, volatility of a year.

    With columns intensity (jumps a year), jump_mean and jump_vol (of log jumps) each step may also jump, and the drift is
    set off by the mean of jumps. A step takes one draw without and three with jumps, whether it jumps or not. Equal
    parameters and seeds give equal paths for each key. A null parameter gives a null return.
    """
    jumps = "intensity" in rows.columns
    steps = rows.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))).withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    number = F.col("path").cast("long") * days + F.col("day")
    draws = 3 if jumps else 1
    for k in range(draws):
        steps = with_uniform(steps, f"u{k}", number * draws + k, seed)
    drift = F.col("drift") - 0.5 * F.col("volatility") * F.col("volatility")
    if jumps:
        drift = drift - F.col("intensity") * (F.exp(F.col("jump_mean") + 0.5 * F.col("jump_vol") * F.col("jump_vol")) - 1)
    step = drift / YEAR + F.col("volatility") * (1 / YEAR) ** 0.5 * normal("u0")
    if jumps:
        step = step + F.when(F.col("u1") < F.col("intensity") / YEAR, F.col("jump_mean") + F.col("jump_vol") * normal("u2")).otherwise(0.0)
    return steps.groupBy("key", "path").agg(((F.exp(F.sum(step)) - 1) * 100).alias("return_pct"))


def forecast(ends: DataFrame) -> DataFrame:
    """Per key over its paths: mean, deviation and quantiles of the return in percent, and shares above 0 and 5, below -5 and -8.

    A quantile is the value at place floor(q * paths) in order; the list it is read from is as long as there are paths.
    """
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    r = F.col("return_pct")
    out = ends.filter(r.isNotNull()).groupBy("key").agg(
        F.avg(r).alias("mean_return_pct"), F.stddev_pop(r).alias("sigma_return_pct"), F.array_sort(F.collect_list(r)).alias("_ends"),
        share(r > 0).alias("prob_up"), share(r < -5).alias("prob_down_5pct"), share(r < -8).alias("prob_down_8pct"), share(r > 5).alias("prob_up_5pct"),
    )
    at = lambda q: F.get("_ends", F.least(F.size("_ends") - 1, F.floor(q * F.size("_ends")).cast("int")))
    return out.withColumns({f"p{round(q * 100):02d}": at(q) for q in QUANTILES}).drop("_ends")


def radical_inverse(n: Column, base: int) -> Column:
    """The number's digits mirrored behind the point, for numbers of 32 bits: low-discrepancy points of one dimension."""
    out, weight = F.lit(0.0), 1.0
    while weight < WORD:
        out = out + F.floor(n / weight) % base * (1 / (weight * base))
        weight *= base
    return out


def low_discrepancy(n: Column) -> tuple[Column, Column]:
    """Points of two dimensions: mirrored digits of base 2, and of base 3 of the number behind it."""
    return radical_inverse(n, 2), radical_inverse(n + 1, 3)


def quasi_uniform(n: Column, dimension: int = 0) -> Column:
    """One scrambled point of base 2, off 0 and 1."""
    mixed = (n.cast("long") + 1).bitwiseXOR(F.lit(SCRAMBLES[0 if dimension == 0 else 1]))
    return F.least(F.lit(1 - POINT_EDGE), F.greatest(F.lit(POINT_EDGE), radical_inverse(mixed, 2)))
