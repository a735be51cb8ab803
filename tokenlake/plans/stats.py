"""Statistics over tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODULUS = 1_000_000_007


def tally(tokens: DataFrame, *by: str) -> DataFrame:
    """(by, tokens, bytes)"""
    return tokens.groupBy(*by).agg(F.count("*").alias("tokens"), F.sum("length").alias("bytes"))


def order_checksum(tokens: DataFrame, key: str) -> DataFrame:
    """(key, checksum): the fold 31 * h + kind + 1 modulo a prime over each text's tokens, in order.

    Each token adds its kind times the inverse power of 31 that its place gives, and the power of the last place scales the sum, so nothing is gathered
    or joined: partial sums add up where the tokens are, one row a text.
    """
    part = F.pmod((F.col("kind") + 1) * _power(F.col("seq"), pow(31, -1, MODULUS)), F.lit(MODULUS))
    sums = tokens.groupBy(key).agg(F.sum(part).alias("sum"), F.max("seq").alias("last"))
    return sums.select(key, F.pmod(F.pmod("sum", F.lit(MODULUS)) * _power(F.col("last"), 31), F.lit(MODULUS)).alias("checksum"))


def _power(n: Column, base: int) -> Column:
    """The base's n-th power modulo the prime, for n up to 2 ** 30, from three tables of powers."""
    out = F.lit(1).cast("long")
    for shift in (0, 10, 20):
        table = [pow(base, i << shift, MODULUS) for i in range(1024)]
        digit = F.shiftright(n, shift).bitwiseAND(F.lit(1023)).cast("int")
        out = F.pmod(out * F.element_at(F.lit(table), digit + 1), F.lit(MODULUS))
    return out


def gaps(positions: DataFrame, key: str, at: str = "start") -> DataFrame:
    """(key, positions, mean_gap, widest_gap) of places in texts; gaps are between neighbours, 0 for a single place."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    gap = positions.withColumn("gap", F.col(at) - before)
    return gap.groupBy(key).agg(F.count("*").alias("positions"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_gap"), F.coalesce(F.max("gap"), F.lit(0).cast("long")).alias("widest_gap"))


def evenness(largest: Column, size: Column, chunks: Column) -> Column:
    """The largest chunk over an even share; not a number for an empty text."""
    return F.when(size > 0, largest / (F.when(size > 0, size) / chunks)).when(size == 0, F.lit(float("nan")))


def balance(plan: DataFrame, key: str) -> DataFrame:
    """(key, chunks, balance): the largest chunk over an even share."""
    size = F.col("end") - F.col("begin")
    sums = plan.groupBy(key).agg(F.count("*").alias("chunks"), F.max(size).alias("largest"), F.sum(size).alias("size"))
    return sums.select(key, "chunks", evenness(F.col("largest"), F.col("size"), F.col("chunks")).alias("balance"))


def quantiles(rows: DataFrame, by: str, value: str, percents: dict[str, int], **sums: str) -> DataFrame:
    """(by, sums and quantiles): of each group the least value that so many percent of its values do not exceed, nulls left out, and sums of other columns.

    Equal values are counted first, and counts add up in order, so no group's values are held together.
    """
    counted = rows.groupBy(by, value).agg(F.count(value).alias("_n"), *[F.sum(c).alias(n) for n, c in sums.items()])
    group = Window.partitionBy(by)
    upto = F.sum("_n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.select("*", upto.alias("_upto"), F.sum("_n").over(group).alias("_all"))
    least = [F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * p, F.col(value))).alias(n) for n, p in percents.items()]
    return placed.groupBy(by).agg(*[F.sum(n).alias(n) for n in sums], *least)


def line_start_states(d: DataFrame, start: DataFrame) -> DataFrame:
    """(grammar, state): what any scan may be in at a line's start, an upper bound from the transitions alone."""
    from ..operators.relations import reachable

    ends = d.where("byte = 10").join(reachable(d, start), ["grammar", "state"], "left_semi")
    return ends.select("grammar", F.col("next").alias("state")).unionByName(start.select("grammar", "state")).distinct()
