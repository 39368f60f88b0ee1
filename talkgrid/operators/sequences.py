"""Analytics of ordered rows, without a task that holds a whole group."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Time of a block in the unit of the order column: an hour, in milliseconds.
BLOCK = 3_600_000


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: list[str], block: int = BLOCK) -> DataFrame:
    """``df`` with ``prev_<value>`` of the row before, in the group of ``keys`` by ``order``; null for the first row.

    The first of ``order`` is a bigint time; the others break ties. A group is worked on in blocks of time, so a hot
    group is spread over its blocks; the last row of a block is handed to the next one that has rows. ``order`` must
    tell the rows of a group apart; it must not be null, and values may be.
    """
    rows = df.withColumn("__block", F.expr(f"floor({order[0]} / {float(block)}D)"))
    row = F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    rows = rows.withColumn("__prev", F.lag(row).over(inside)).withColumn("__next", F.lead(F.lit(1)).over(inside))
    # The first and last rows of all blocks form a group of their own, two a block; the other rows stay in their blocks.
    edge = F.col("__prev").isNull() | F.col("__next").isNull()
    rows = rows.withColumn("__edge", F.when(~edge, F.col("__block")))
    across = Window.partitionBy(*keys, "__edge").orderBy(*order)
    rows = rows.withColumn("__prev", F.coalesce("__prev", F.lag(row).over(across)))
    return rows.select(*df.columns, *[F.col(f"__prev.v{i}").alias(f"prev_{v}") for i, v in enumerate(values)])


def with_last_known(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``name``: the last non-null ``value`` up to each row, in the group of ``keys`` by ``order``.

    In blocks of time, as ``with_previous``; a block starts with what the blocks before it ended with.
    """
    place = [*keys, "__block"]
    rows = df.withColumn("__block", F.expr(f"floor({order[0]} / {float(block)}D)")).withColumn("__value", value)
    inside = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    position = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col("__value").alias("value"))
    ends = rows.groupBy(*place).agg(F.max(F.when(F.col("__value").isNotNull(), position)).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*place, F.last("__end.value", ignorenulls=True).over(before).alias("__carried"))
    out = rows.withColumn("__known", F.last("__value", ignorenulls=True).over(inside)).join(ends, place, "left")
    return out.select(*df.columns, F.coalesce("__known", "__carried").alias(name))


def with_position(df: DataFrame, keys: list[str], order: list[str], block: int = BLOCK) -> DataFrame:
    """``df`` with ``pos``: the number of rows before, in the group of ``keys`` by ``order``; in blocks, as ``with_previous``."""
    place = [*keys, "__block"]
    rows = df.withColumn("__block", F.expr(f"floor({order[0]} / {float(block)}D)"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("__n")).select(*place, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(*place).orderBy(*order))
    return rows.withColumn("__row", inside).join(base, place).select(*df.columns, (F.col("__base") + F.col("__row") - 1).alias("pos"))


def turns(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments that begin a turn: the first of a group, or by another speaker than the row before; not empty ones.

    ``segments`` has ``s``, ``e``, ``idx``, ``speaker_id``. Continuations by the same speaker belong to no turn.
    """
    rows = with_previous(segments, keys, ["s", "idx"], ["speaker_id"])
    return rows.filter("(prev_speaker_id IS NULL OR prev_speaker_id <> speaker_id) AND e > s").drop("prev_speaker_id")


def gap_merge(df: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Regions [s, e] of each group whose distance is at most ``gap``, as one: ``keys``, ``s``, ``e``, ``members``.

    Sessions of silence in between. The regions' ends are moved by the gap, united by run containers, and moved back,
    so groups are spread over time shards; a group of any size is never in one task.
    """
    from talkgrid.operators.coverage import merged_periods

    # In half units, so that spans of a point have a length, and only distances up to the gap close.
    wide = df.select(*keys, (F.col("s") * 2).alias("s"), (F.col("e") * 2 + 2 * gap + 1).alias("e"))
    merged = merged_periods(wide, keys)
    return merged.select(*keys, F.expr("s div 2").alias("s"), F.expr(f"(e - {2 * gap + 1}) div 2").alias("e"), F.col("n").alias("members"))


def _joined_runs(parts: DataFrame, keys: list[str], fresh: Column, values: list[Column], order: list[str]) -> DataFrame:
    """Parts of runs (``__group`` is null where the run may go on in another block) put together: ``keys`` and ``values``.

    ``fresh`` tells whether a part begins a run. Parts that can't go on are runs already, and stay in their blocks.
    """
    w = Window.partitionBy(*keys, "__group").orderBy(*order)
    number = F.sum(F.when(F.col("__fresh"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = parts.withColumn("__fresh", fresh).withColumn("__number", number)
    return rows.groupBy(*keys, "__group", "__number").agg(*values).drop("__group", "__number")


def hysteresis(frames: DataFrame, keys: list[str], enter: float, leave: float, block: int = 8192) -> DataFrame:
    """Events of each series: a run starts at a score >= ``enter`` and lasts to the first <= ``leave``, that one included.

    ``frames`` has ``keys``, ``frame`` (bigint, distinct in a series), ``t0``, ``t1`` and ``score``; null scores keep
    the state. ``enter`` must be above ``leave``. Result: ``keys``, ``first`` and ``last`` frame, ``s`` (first
    ``t0``), ``e`` (last ``t1``), ``peak``, ``frames``.

    One pass: in blocks of frames, so one of any length is spread. In a block, rows are aggregated to parts of runs: what
    comes before the first row that sets the state, and runs. Only the first two and the last part of a block depend on
    others; they are put in order over the blocks, three a block, and joined there.
    """
    if not enter > leave:
        raise ValueError("enter must be above leave")
    state = F.when(F.col("score") >= enter, 1).when(F.col("score") <= leave, 0)
    rows = frames.select(*keys, "frame", "t0", "t1", "score", F.expr(f"floor(frame / {float(block)}D)").alias("__block"), state.alias("__set"))
    w = Window.partitionBy(*keys, "__block").orderBy("frame")
    known = F.last("__set", ignorenulls=True)
    rows = rows.withColumn("__on", known.over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__was", known.over(w.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.expr("__set = 1 AND coalesce(__was, 0) = 0")
    rows = rows.withColumn("__run", F.last(F.when(opens, F.col("frame")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # head rows (no run, nothing known before) go to a run of an earlier block if it is still on
    rows = rows.filter("(__run IS NULL AND __was IS NULL) OR __on = 1 OR __was = 1")
    parts = rows.groupBy(*keys, "__block", "__run").agg(
        F.min("frame").alias("first"), F.max("frame").alias("last"), F.min("t0").alias("s"), F.max("t1").alias("e"), F.max("score").alias("peak"), F.count(F.lit(1)).alias("frames"),
        F.bool_or(F.expr("__on IS NOT NULL AND __on = 0")).alias("__closed"), F.bool_or(F.expr("__set = 1 AND __was IS NULL")).alias("__joins"),
    )
    b = Window.partitionBy(*keys, "__block").orderBy("first")
    # the last part of a block tells the state that the next one begins with
    edge = F.col("__run").isNull() | F.coalesce("__joins", F.lit(False)) | F.lead(F.lit(1)).over(b).isNull()
    parts = parts.withColumn("__group", F.when(~edge, F.col("__block")))
    after = F.when(F.coalesce("__closed", F.lit(False)), 0).when(F.col("__run").isNotNull(), 1)
    before = Window.partitionBy(*keys, "__group").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.last(after, ignorenulls=True).over(before), F.lit(0))).filter("__run IS NOT NULL OR __before = 1")
    fresh = F.expr("__run IS NOT NULL AND NOT (coalesce(__joins, false) AND __before = 1)")
    return _joined_runs(parts, keys, fresh, [F.min("first").alias("first"), F.max("last").alias("last"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("peak").alias("peak"), F.sum("frames").alias("frames")], ["first"])


def joined_rows(df: DataFrame, keys: list[str], order: list[str], carried: list[str], breaks: str, parts: dict[str, tuple[Column, Column]], block: int = BLOCK) -> DataFrame:
    """Runs of neighbouring rows of each group by ``order``: ``keys`` and the aggregates ``parts``.

    ``breaks`` is SQL that tells from ``carried`` columns, as they are and as ``prev_<name>`` of the row before, whether a
    row begins a run (null: it does not). ``parts`` are, by name, an aggregate of rows and one of such aggregates. One
    pass, in blocks of ``order[0]``: only the first and the last run of a block can go on in another, and these alone are
    put in order over the blocks.
    """
    rows = df.withColumn("__block", F.expr(f"floor({order[0]} / {float(block)}D)"))
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    row = F.struct(*carried)
    rows = rows.withColumn("__prev", F.lag(row).over(inside)).withColumns({f"prev_{c}": F.col(f"__prev.{c}") for c in carried})
    rows = rows.withColumn("__fresh", F.when(F.col("__prev").isNull() | F.coalesce(F.expr(breaks), F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("__run", F.sum("__fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    here = F.struct(F.struct(*order).alias("at"), row.alias("row"))
    found = rows.groupBy(*keys, "__block", "__run").agg(*[first.alias(name) for name, (first, _) in parts.items()], F.min(here).alias("__head"), F.max(here).alias("__tail"))
    is_last = F.lead(F.lit(1)).over(Window.partitionBy(*keys, "__block").orderBy("__run")).isNull()
    found = found.withColumn("__group", F.when(~(is_last | (F.col("__run") == 1)), F.col("__block"))).withColumn("__at", F.col("__head.at"))
    found = found.withColumn("__before", F.lag("__tail.row").over(Window.partitionBy(*keys, "__group").orderBy("__at")))
    # a run that isn't the first of its block is apart from the one before; the first is measured against it
    given = [c for c in found.columns if c not in carried and c not in parts]
    kept = [F.col(name).alias(f"__part_{name}") for name in parts]
    found = found.select(*given, *kept, *[F.col(f"__head.row.{c}").alias(f"__row_{c}") for c in carried], *[F.col(f"__before.{c}").alias(f"__prev_{c}") for c in carried])
    names = {c: f"__row_{c}" for c in carried} | {f"prev_{c}": f"__prev_{c}" for c in carried}
    fresh = F.col("__before").isNull() | (F.col("__run") > 1) | F.coalesce(F.expr(_renamed(breaks, names)), F.lit(False))
    values = [second.alias(name) for name, (_, second) in parts.items()]
    return _joined_runs(found, keys, fresh, values, ["__at"])


def _renamed(sql: str, names: dict[str, str]) -> str:
    return re.sub(r"\b\w+\b", lambda m: names.get(m[0], m[0]), sql)


def part(name: str) -> Column:
    """What ``joined_rows`` has aggregated under a name, to be aggregated again."""
    return F.col(f"__part_{name}")


def merge_runs(runs: DataFrame, keys: list[str], start: str, end: str, gap: float, block: int = BLOCK) -> DataFrame:
    """Disjoint runs of a series in order, joined where ``start`` is at most ``gap`` after the ``end`` before: with ``peak``.

    Result: ``keys``, ``first``, ``last``, ``s``, ``e``, ``peak``, ``runs``.
    """
    parts = {"first": F.min, "last": F.max, "s": F.min, "e": F.max, "peak": F.max}
    both = {name: (f(name), f(part(name))) for name, f in parts.items()} | {"runs": (F.count(F.lit(1)), F.sum(part("runs")))}
    return joined_rows(runs, keys, [start], list(dict.fromkeys([start, end])), f"{start} - prev_{end} > {float(gap)!r}D", both, block)


def median_filter(frames: DataFrame, keys: list[str], k: int, block: int = 8192) -> DataFrame:
    """``frames`` with ``smooth``: the median of the ``k`` scores around each (odd ``k``); at the ends the outer score is repeated.

    Works in blocks of frames that also see ``k // 2`` frames on either side; frames of a series are numbered without holes, and scores aren't null.
    """
    if k < 1 or k % 2 == 0:
        raise ValueError("k must be odd")
    h = k // 2
    home = F.expr(f"floor(frame / {float(block)}D)")
    near = F.array_distinct(F.array(home, F.expr(f"floor((frame - {h}) / {float(block)}D)"), F.expr(f"floor((frame + {h}) / {float(block)}D)")))
    rows = frames.withColumn("__home", home).withColumn("__block", F.explode(near))
    w = Window.partitionBy(*keys, "__block").orderBy("frame")
    around = F.collect_list("score").over(w.rowsBetween(-h, h))
    before, after = F.count(F.lit(1)).over(w.rowsBetween(-h, -1)) if h else F.lit(0), F.count(F.lit(1)).over(w.rowsBetween(1, h)) if h else F.lit(0)
    # fewer than h neighbours in the block that is home are only found at an end of the series
    padded = F.concat(F.array_repeat(F.get("__near", F.lit(0)), h - F.col("__before")), F.col("__near"), F.array_repeat(F.element_at("__near", -1), h - F.col("__after")))
    rows = rows.withColumn("__near", around).withColumn("__before", before.cast("int")).withColumn("__after", after.cast("int")).filter("__block = __home")
    return rows.withColumn("smooth", F.get(F.sort_array(padded), F.lit(h))).select(*frames.columns, "smooth")


def first_seen_labels(df: DataFrame, keys: list[str], label: str, order: list[str], prefix: str = "Speaker_") -> DataFrame:
    """The labels of each group, renamed ``prefix`` and a number from 1 by first appearance: ``keys``, ``label``, ``renamed``.

    Labels are counted before the shuffle; only the distinct ones of a group are ordered. Null labels don't take part.
    """
    firsts = df.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.min(F.struct(*order)).alias("__first"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("__first", label))
    return firsts.select(*keys, label, F.concat(F.lit(prefix), number.cast("string")).alias("renamed"))
