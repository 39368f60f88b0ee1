"""Problem 1: the N highest-scoring items of every group.

Method: simultaneous bisection of all groups. Each item gets an order-preserving code (the bits of its score, then
its inverted identifier). A group is an interval of codes and a number of items still to be found in it; each round
counts its items above several midpoints at once and keeps only the section that holds the cutoff, until what is
left is exactly what is needed. A round moves counts and the items still in question, never a whole group to one
task, and a group of any size needs the same few rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.operators.skew import heavy_groups
from talkgrid.storage import Workspace

#: Sections into which a round cuts an interval. Each round narrows an interval by this factor.
SECTIONS = 256


def double_code(x: Column) -> Column:
    """A long that orders like the double ``x`` (finite or infinite, not NaN); -0.0 equals 0.0.

    Sign, exponent and mantissa side by side, as the IEEE bits are, made of arithmetic that is exact in doubles.
    """
    a = F.abs(x)
    guess = F.floor(F.log2(a))
    power = F.when(F.pow(F.lit(2.0), guess) > a, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= a, guess + 1).otherwise(guess)
    step = F.lit(float(2**52))
    normal = (power + 1023) * F.lit(2**52).cast("bigint") + ((a / F.pow(F.lit(2.0), power) - 1.0) * step).cast("bigint")
    size = (
        F.when(a == F.lit(float("inf")), F.lit(2047 * 2**52).cast("bigint"))
        .when(a < F.lit(2.0**-1022), (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint"))
        .otherwise(normal)
    )
    return F.when(x < 0, -size).otherwise(size)


#: Section of v in [lo, hi]. An interval across zero is cut at zero, so that no difference overflows.
_SECTION = f"CASE WHEN lo < 0 AND hi >= 0 THEN IF(v >= 0, 1L, 0L) ELSE (v - lo) div ((hi - lo) div {SECTIONS} + 1) END"


def _round(rows: DataFrame, names: list[str], hot: bool) -> DataFrame:
    """One bisection of the group intervals carried by ``rows``: what is chosen, and what is still in question.

    Groups that are not hot lie whole in one partition of ``rows``, so nothing of this is shuffled. Hot ones are
    counted where they lie, and only their counts move.
    """
    rows = rows.withColumn("v", F.when(F.col("by_id"), F.col("i")).otherwise(F.col("c")))
    rows = rows.withColumn("s", F.expr(_SECTION)).drop("lo", "hi")
    counts = rows.groupBy(*names, "s").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.first("by_id").alias("by_id"), F.first("need").alias("need")
    )
    group = Window.partitionBy(*names)
    counts = counts.withColumn("upto", F.sum("cnt").over(group.orderBy(F.col("s").desc()))).withColumn("size", F.sum("cnt").over(group))
    # the section with the cutoff, or the lowest one where the group has no more items than needed
    cut = counts.filter("(upto >= need AND upto - cnt < need) OR (upto = size AND size < need)").select(
        *names, F.col("s").alias("cut"), "v0", "v1",
        F.expr("need - (upto - cnt)").alias("left"), F.expr("cnt <= need - (upto - cnt)").alias("all_in"),
    )
    joined = rows.drop("need", "v").join(F.broadcast(cut) if hot else cut, names).filter("s >= cut")
    return joined.select(
        *names, "c", "i", F.col("left").alias("need"), F.expr("s > cut OR all_in").alias("chosen"),
        # items of one score are told apart by identifier; its interval is that of all until the next round
        F.expr("by_id OR v0 = v1").alias("by_id"),
        F.expr("CASE WHEN by_id OR v0 < v1 THEN v0 END").alias("lo"), F.expr("CASE WHEN by_id OR v0 < v1 THEN v1 END").alias("hi"),
    )


def top_n_per_group(df: DataFrame, keys: list[str], score: str, ident: str, n: int, decimals: int | None = None, unique: bool = False) -> DataFrame:
    """The ``n`` best rows of each group of ``keys``: highest ``score`` first, of equal scores the smaller ``ident``.

    ``ident`` is a bigint; rows that repeat key, score and ``ident`` count once (``unique``: there are none, so they
    aren't looked for). Scores are compared after rounding to ``decimals``, if given. Rows with a null key, null or
    NaN score, or null ``ident`` don't take part; a group of up to ``n`` rows comes out whole; an empty table gives an
    empty table. Result: ``keys`` and ``ident``; other columns are neither read nor confused with those of the
    operator. Needs a job a round; rounds end when no group is in question.
    """
    spark = df.sparkSession
    names = [f"k{j}" for j in range(len(keys))]
    value = F.round(F.col(score), decimals) if decimals is not None else F.col(score)
    items = (
        df.select(*[F.col(k).alias(a) for k, a in zip(keys, names)], value.alias("x"), F.bitwise_not(F.col(ident)).alias("i"))
        .filter(" AND ".join([f"{a} IS NOT NULL" for a in names] + ["x IS NOT NULL", "NOT isnan(x)", "i IS NOT NULL"]))
        .select(*names, double_code(F.col("x")).alias("c"), "i")
    )
    space = Workspace(spark)
    rows = space.write(items if unique else items.distinct(), "rest")
    total, lo, hi, id_lo, id_hi = rows.agg(F.count(F.lit(1)), F.min("c"), F.max("c"), F.min("i"), F.max("i")).first()
    long = lambda x: F.lit(x).cast("bigint")
    found = [rows.select(*names, "i").limit(0)]
    hot = heavy_groups(rows, names, total, space)
    # a round's rows carry the interval of their group: whether it is one of identifiers, its ends, and the need
    rows = rows.select(*names, "c", "i", long(n).alias("need"), F.lit(False).alias("by_id"), long(lo).alias("lo"), long(hi).alias("hi"))
    round_no = 0
    while total:
        light = rows if hot is None else rows.join(F.broadcast(hot), names, "left_anti")
        step = _round(light.repartition(*names), names, hot=False)
        if hot is not None:
            step = step.unionByName(_round(rows.join(F.broadcast(hot), names, "left_semi"), names, hot=True))
        step = step.withColumn("lo", F.coalesce("lo", long(id_lo))).withColumn("hi", F.coalesce("hi", long(id_hi)))
        done = space.write(step, f"round{round_no}", ["chosen"])
        if round_no == 0:
            space.drop("rest")
        found.append(done.filter("chosen").select(*names, "i"))
        rows = done.filter("NOT chosen").drop("chosen")
        total, round_no = rows.count(), round_no + 1
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result.select(*[F.col(a).alias(k) for k, a in zip(keys, names)], F.bitwise_not(F.col("i")).alias(ident))
