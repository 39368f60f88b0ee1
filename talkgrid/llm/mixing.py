"""Problem 7: mixing sources to target weights.

Method: Pareto order sampling. Each source first gets as many whole copies of all its documents as its target allows.
The rest is drawn: a document with random number u and inclusion probability p ranks by (u / (1 - u)) / (p / (1 - p)),
and the lowest ranks are taken until the rest is filled. Inclusion probabilities are unequal: they grow with the square
root of a document's size, so that a draw needs fewer, longer documents. Random numbers are hashes of identifiers, so
a draw is the same on every run.

The cutoff of a source is found by counting sizes in rank cells, twice, and sorting only the last cell, which holds
about 2**-24 of a source; so a source of any size is handled without being in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.storage import Workspace

#: Bits of a rank, and of each of the two steps that narrow the cutoff down.
_RANK_BITS, _STEP_BITS = 48, 12
#: So many targets are broadcast; with more, sources join by a shuffle.
MOST_SOURCES = 100_000


def _sent(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def mix_plan(sizes: DataFrame, targets: DataFrame, few: bool = False) -> DataFrame:
    """By source of ``targets`` (``source``, ``target_share``, ``max_repeats``): size, desired size, whole copies, rest to draw.

    ``sizes`` has ``source``, ``n``. The desired size is the target share of the size of all documents of these sources.
    """
    have = sizes.join(_sent(targets.select("source"), few), "source").groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n").alias("size"), F.sum(F.sqrt("n") * F.col("n")).alias("weighted")
    )
    plan = targets.join(have, "source", "left").fillna(0, ["documents", "size"]).fillna(0.0, ["weighted"])
    plan = plan.withColumn("desired", F.col("target_share") * F.sum("size").over(Window.partitionBy()))
    plan = plan.withColumn("goal", F.least(F.col("desired"), (F.col("max_repeats") * F.col("size")).cast("double")))
    copies = F.when(F.col("size") > 0, F.floor(F.col("goal") / F.col("size"))).otherwise(F.lit(0).cast("bigint"))
    return plan.withColumn("copies", copies).withColumn("rest", F.col("goal") - F.col("copies") * F.col("size"))


def _narrow(ranked: DataFrame, bits: int, few: bool) -> DataFrame:
    """``ranked`` (source, rank, id, n, base, rest) reduced to each source's cell that holds its cutoff; base and rest follow."""
    cells = ranked.groupBy("source", F.expr(f"shiftright(rank, {bits})").alias("cell")).agg(F.sum("n").alias("size"), F.first("rest").alias("rest"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("cell"))
    cut = cells.withColumn("upto", upto).filter("upto >= rest AND upto - size < rest")
    cut = cut.select("source", "cell", (F.col("rest") - (F.col("upto") - F.col("size"))).alias("left"))
    inside = ranked.join(_sent(cut, few), "source").filter(f"shiftright(rank, {bits}) = cell")
    return inside.select("source", "rank", "id", "n", F.expr(f"shiftleft(cell, {bits})").alias("base"), F.col("left").alias("rest"))


def mix_sources(documents: DataFrame, targets: DataFrame, ident: str, source: str, size: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The drawn documents (``ident``, ``source``, ``size``, ``copies``), and the report of shares reached.

    ``ident`` is a bigint, ``size`` a bigint >= 0 (null counts as 0); ``source`` is compared with ``targets.source``
    (``target_share``, ``max_repeats``) as it is. Documents of other or null sources are not drawn; targets with a null
    field or a negative number don't take part; of several targets of one source the first by share and repeats counts.
    Documents of one ``ident`` and source are drawn together. Empty documents come with the whole copies only.

    Report, one row a target: ``documents``, ``available`` and ``desired`` size, ``drawn`` size, ``target_share``,
    ``actual_share`` (null if nothing is drawn), ``max_repeats`` and ``short``: every document was drawn
    ``max_repeats`` times and the target still isn't reached. Targets are broadcast where there
    are at most ``MOST_SOURCES``; documents never are. Documents with a null ``ident`` are of one ident.
    """
    spark = documents.sparkSession
    space = Workspace(spark)
    targets = targets.filter("source IS NOT NULL AND target_share >= 0 AND max_repeats >= 0 AND NOT isnan(target_share)")
    targets = space.write(targets.groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*"), "targets")
    few = targets.count() <= MOST_SOURCES
    rows = documents.select(F.coalesce(F.col(ident), F.lit(-1).cast("bigint")).alias("id"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"))
    rows = space.write(rows, "sizes")
    plan = space.write(mix_plan(rows, targets, few), "plan")
    # the random number has 53 bits and is never 0 or 1
    u = (F.expr(f"shiftrightunsigned(xxhash64(id, {int(seed)}L), 11)").cast("double") + 0.5) / F.lit(float(2**53))
    share = F.col("rest") * F.sqrt("n") / F.col("weighted")
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-12), share))
    odds = (u / (1 - u)) / (p / (1 - p))
    # a document whose share is 1 or more is certain: it comes before all that are drawn
    rank = F.when(share >= 1, 0).otherwise(1 + F.floor(odds / (1 + odds) * F.lit(float(2**_RANK_BITS - 2)))).cast("bigint")
    ranked = rows.join(_sent(plan.select("source", "copies", "rest", "weighted"), few), "source").withColumn("rank", F.when((F.col("rest") > 0) & (F.col("n") > 0), rank))
    ranked = ranked.select("source", "id", "n", "copies", "rest", "rank")
    cell = ranked.filter("rank IS NOT NULL").select("source", "rank", "id", "n", F.lit(0).cast("bigint").alias("base"), "rest")
    for step in (1, 2):
        cell = _narrow(cell, _RANK_BITS - step * _STEP_BITS, few)
    w = Window.partitionBy("source").orderBy("rank", "id")
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    # the document across the border comes along if that is nearer to the goal
    cell = cell.withColumn("upto", upto).withColumn("taken", F.expr("upto - rest <= rest - (upto - n)"))
    cut = cell.groupBy("source").agg(F.max(F.when(F.col("taken"), F.struct("rank", "id"))).alias("last"), F.min("base").alias("base"))
    cut = space.write(cut.select("source", F.coalesce(F.col("last"), F.struct((F.col("base") - 1).alias("rank"), F.lit(2**63 - 1).alias("id"))).alias("last")), "cut")
    drawn = ranked.join(_sent(cut, few), "source", "left")
    extra = F.expr("IF(rank IS NOT NULL AND struct(rank, id) <= last, 1L, 0L)")
    drawn = drawn.select("id", "source", "n", (F.col("copies") + extra).alias("copies")).filter("copies > 0")
    got = drawn.groupBy("source").agg(F.sum(F.col("n") * F.col("copies")).alias("drawn"))
    report = plan.join(got, "source", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("bigint")))
    report = report.select(
        "source", "documents", F.col("size").alias("available"), "desired", "drawn", "target_share",
        F.expr("try_divide(CAST(drawn AS double), CAST(sum(drawn) OVER () AS double))").alias("actual_share"), "max_repeats",
        F.expr("drawn = max_repeats * size AND drawn < desired").alias("short"),
    )
    return drawn.select(F.col("id").alias(ident), "source", F.col("n").alias(size), "copies"), report
