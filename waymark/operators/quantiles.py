"""Exact quantiles by distributed selection.

Doubles become 64-bit integers of the same order.  Equal values are counted
first, in one shuffle by (key, value), so neither a large group nor a frequent
value meets in a task.  Then 16 bits at a time: the histogram of the values'
next bits (at most 65,536 rows a key, summed over by a window) says in which
bucket the wanted ranks lie, and only that bucket goes on.  After four steps
the bucket is the value.  Quantiles are interpolated linearly between two
ranks, as NumPy's default.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FRACTION = 1 << 52
_STEPS = (48, 32, 16, 0)


def ordered_bits(value: Column) -> Column:
    """A long for each double, in the same order; the two zeros are one, NaN is above infinity, null stays null.

    It is the double's IEEE pattern, computed by exact powers of two.
    """
    x = F.abs(value.cast("double"))
    guess = F.floor(F.log2(x))
    power = lambda e: F.pow(F.lit(2.0), e)
    e = F.when(power(guess) > x, guess - 1).when(power(guess + 1) <= x, guess + 1).otherwise(guess)
    normal = (e + 1023) * F.lit(_FRACTION) + ((x / power(e) - 1) * float(_FRACTION)).cast("long")
    tiny = (x * 2.0**537 * 2.0**537).cast("long")  # below 2**-1022 the pattern has no exponent
    bits = F.when(F.isnan(x), F.lit(2047 * _FRACTION + 1)).when(x == float("inf"), F.lit(2047 * _FRACTION)).when(x < 2.0**-1022, tiny).otherwise(normal)
    return F.when((value < 0) & ~F.isnan(value), -bits).otherwise(bits)


def from_bits(bits: Column) -> Column:
    """The double of :func:`ordered_bits`."""
    size = F.abs(bits)
    e, m = F.shiftright(size, 52), F.pmod(size, F.lit(_FRACTION))
    normal = F.pow(F.lit(2.0), e - 1023) * (1 + m / float(_FRACTION))
    x = F.when(size > 2047 * _FRACTION, F.lit(float("nan"))).when(size == 2047 * _FRACTION, F.lit(float("inf"))).when(e == 0, size * 2.0**-537 * 2.0**-537).otherwise(normal)
    return F.when(bits < 0, -x).otherwise(x)


def of_counts(counts: DataFrame, keys: list[str], probabilities: dict[str, float], bits: str = "bits", n: str = "n") -> DataFrame:
    """One row a key with a column for each name of ``probabilities``, from counted values (keys, ``bits``, ``n``; null bits count as often as ``n`` says, 0 for not at all)."""
    rows = counts.select(*keys, F.col(bits).alias("_bits"), F.col(n).alias("_n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probabilities.items()])
    by = Window.partitionBy(*keys)
    prefix = lambda shift: F.shiftright("_bits", shift)

    first = rows.groupBy(*keys, prefix(_STEPS[0]).alias("_b")).agg(F.sum("_n").alias("_m"))
    before = F.coalesce(F.sum("_m").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_m").over(by)
    ranks = F.array_distinct(F.flatten(F.transform(wanted, lambda w: F.array(F.floor(w["p"] * (F.col("_total") - 1)), F.ceil(w["p"] * (F.col("_total") - 1))))))
    found = first.withColumns({"_before": before, "_total": total}).withColumn("_rank", F.explode(ranks))
    picks = _pick(found).select(*keys, "_total", "_rank", "_b", (F.col("_rank") - F.col("_before")).alias("_left"))
    for shift, wider in zip(_STEPS[1:], _STEPS, strict=False):
        inside = _same(rows.withColumn("_b", prefix(wider)), picks, [*keys, "_b"])
        level = inside.groupBy(*keys, "_total", "_rank", "_left", prefix(shift).alias("_c")).agg(F.sum("_n").alias("_m"))
        own = Window.partitionBy(*keys, "_rank")
        before = F.coalesce(F.sum("_m").over(own.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = level.withColumn("_before", before).where((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_m")))
        picks = found.select(*keys, "_total", "_rank", F.col("_c").alias("_b"), (F.col("_left") - F.col("_before")).alias("_left"))
    values = picks.select(*keys, "_total", F.struct("_rank", from_bits(F.col("_b")).alias("v")).alias("r"))
    each = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list("r")).alias("_m"), F.max("_total").alias("_total"))  # two ranks a quantile

    def quantile(p: float) -> Column:
        at = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.element_at("_m", F.floor(at)), F.element_at("_m", F.ceil(at))
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))

    return each.select(*keys, *[quantile(p).alias(name) for name, p in probabilities.items()])


def _same(rows: DataFrame, picks: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that takes nulls as equal; the optimizer then adds no filter to ``rows``, so all steps read one shuffle of them."""
    named = picks.withColumnsRenamed({c: f"_p_{c}" for c in on})
    met = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in on]
    return rows.join(named, met, "inner").drop(*[f"_p_{c}" for c in on])


def _pick(found: DataFrame) -> DataFrame:
    return found.where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_m")))


def quantiles(df: DataFrame, keys: Iterable[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """One row a key (of those with a value that isn't null) and a column for each name, interpolated linearly."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, ordered_bits(F.col(value)).alias("bits")).agg(F.count("*").alias("n"))
    return of_counts(counts, keys, probabilities)
