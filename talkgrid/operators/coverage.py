"""Problem 3: continuous periods and gaps of overlapping intervals.

Method: time in exact whole units is cut into shards of 2**16 units. Per entity and shard, the units that are covered
are one run-compressed bitmap, a run container: sorted, disjoint runs [start, end) of set bits, with the number of
intervals that begin in each. Containers are made of the intervals of a batch where these lie (Arrow batches; all groups
of a batch at once), so only united containers are shuffled; those of one entity and shard are united again, and the
set runs (periods) and clear runs (gaps) are read off. The first and last runs of a shard are joined across borders.

A container has at most 2**15 runs however many intervals fall into the shard. So a hot entity is spread over its shards,
and no task holds more of one group than a shard can have. Joining across borders sees at most two runs of each shard,
a number that depends on the time covered and not on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.storage import Workspace

#: Units of time in a shard.
SHARD = 1 << 16


def _pieces(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Each interval [s, e) cut at shard borders: at most a head and a tail, plus one whole run for all shards between.

    The whole run lies in the container of its first shard and keeps its true length.
    """
    first, last = F.expr(f"floor(s / {SHARD}.0D)").cast("bigint"), F.expr(f"floor((e - 1) / {SHARD}.0D)").cast("bigint")
    cut = intervals.withColumn("first", first).withColumn("last", last)
    border = lambda shard: f"({shard}) * {SHARD}L"
    return cut.select(
        *keys,
        F.inline(
            F.expr(
                f"""CASE WHEN first = last THEN array(named_struct('shard', first, 's', s, 'e', e, 'n', 1L))
                    WHEN first + 1 = last THEN array(named_struct('shard', first, 's', s, 'e', {border('last')}, 'n', 1L),
                                                     named_struct('shard', last, 's', {border('last')}, 'e', e, 'n', 0L))
                    ELSE array(named_struct('shard', first, 's', s, 'e', {border('first + 1')}, 'n', 1L),
                               named_struct('shard', first + 1, 's', {border('first + 1')}, 'e', {border('last')}, 'n', 0L),
                               named_struct('shard', last, 's', {border('last')}, 'e', e, 'n', 0L)) END"""
            )
        ),
    )


def unite(group: np.ndarray, s: np.ndarray, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The union of run containers: sorted, disjoint runs (group, s, e, n) of those given in any order.

    ``group`` numbers containers, from 0. Runs that overlap or touch are one, with the sum of their ``n``; this is
    associative, so containers of parts can be united in any order.
    """
    if not len(s):
        return group, s, e, n
    order = np.lexsort((s, group))
    group, s, e, n = group[order], s[order], e[order], n[order]
    # the furthest end so far in each container: ends are ranked, and ranks of later containers lie above earlier ones
    ranked, rank = np.unique(e, return_inverse=True)
    furthest = np.maximum.accumulate(rank + group * len(ranked)) - group * len(ranked)
    upto = ranked[furthest]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (s[1:] > upto[:-1])
    first = np.flatnonzero(fresh)
    return group[first], s[first], np.maximum.reduceat(e, first), np.add.reduceat(n, first)


def _lists(group: np.ndarray, groups: int, *values: np.ndarray) -> list[pa.ListArray]:
    """Arrow lists of ``values`` by ``group``, which is sorted."""
    offsets = pa.array(np.searchsorted(group, np.arange(groups + 1)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for v in values]


def _numbered(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, pa.Table]:
    """The number of each row's group, and a row of ``keys`` for each group in order of numbers."""
    table = pa.Table.from_batches([batch.select(keys)]).append_column("__row", pa.array(np.arange(batch.num_rows)))
    firsts = table.group_by(keys, use_threads=False).aggregate([("__row", "min"), ("__row", "list")])
    number = np.empty(batch.num_rows, np.int64)
    lists = firsts["__row_list"].combine_chunks()
    number[lists.values.to_numpy()] = np.repeat(np.arange(len(firsts)), np.diff(lists.offsets.to_numpy()))
    return number, firsts.select(keys)


def _containers(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """The run container of each of ``keys`` (the last one is the shard) as lists ``s``, ``e``, ``n``, of ``pieces`` (s, e, n)."""
    given = pieces.select(*keys, "s", "e", "n")
    lists = [T.StructField(c, T.ArrayType(T.LongType(), False), False) for c in ("s", "e", "n")]
    schema = T.StructType([*given.schema.fields[: len(keys)], *lists])

    def made(number: np.ndarray, names: pa.Table, s: np.ndarray, e: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        group, *runs = unite(number, s, e, n)
        columns = [*(c.combine_chunks() for c in names.columns), *_lists(group, len(names), *runs)]
        return pa.RecordBatch.from_arrays(columns, [*keys, "s", "e", "n"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, names = _numbered(batch, keys)
                yield made(number, names, *(batch.column(c).to_numpy() for c in ("s", "e", "n")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Unites containers in order of their keys; the last of a batch waits for the next, which may go on with it."""
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            both = batch if held is None else pa.RecordBatch.from_arrays([pa.concat_arrays([a.cast(b.type), b]) for a, b in zip(held.columns, batch.columns)], batch.schema.names)
            number, names = _numbered(both, keys)
            lengths = np.diff(both.column("s").offsets.to_numpy())
            out = made(np.repeat(number, lengths), names, *(both.column(c).flatten().to_numpy() for c in ("s", "e", "n")))
            last = int(number[-1])
            held = out.slice(last, 1)
            rest = [out.slice(0, last), out.slice(last + 1)]
            yield from (r for r in rest if r.num_rows)
        if held is not None:
            yield held

    partial = given.mapInArrow(build, schema)
    return partial.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).mapInArrow(merge, schema)


def _periods(intervals: DataFrame, names: list[str]) -> DataFrame:
    """Periods (s, e, n members, next_s) of the valid ``intervals`` (s, e) of each entity."""
    shard = [*names, "shard"]
    containers = Workspace(intervals.sparkSession).write(_containers(_pieces(intervals, names), shard), "containers")
    # set runs between others of the shard, each with the start of the next: what lies between is a clear run
    middle = F.expr("IF(size(s) > 2, transform(sequence(1, size(s) - 2), i -> named_struct('s', s[i], 'e', e[i], 'n', n[i], 'next_s', s[i + 1])), array())")
    inner = containers.filter("size(s) > 2").select(*shard, F.inline(middle))
    # Only the first and the last run of a shard can go on across a border. A shard that an earlier whole run covers
    # has no runs of its own: those inside it fall to that run, with their members.
    ends = F.expr(
        """filter(array(named_struct('s', s[0], 'e', e[0], 'n', n[0], 'next_s', IF(size(s) > 1, s[1], NULL), 'is_first', true,
                'n_inside', IF(size(s) > 2, aggregate(slice(n, 2, size(n) - 2), 0L, (a, x) -> a + x), 0L)),
            IF(size(s) > 1, named_struct('s', s[size(s) - 1], 'e', e[size(s) - 1], 'n', n[size(s) - 1], 'next_s', CAST(NULL AS bigint), 'is_first', false, 'n_inside', 0L), NULL)), x -> x IS NOT NULL)"""
    )
    w = Window.partitionBy(*names).orderBy("s")
    edge = containers.select(*shard, F.inline(ends)).withColumn("upto", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    edge = edge.withColumn("run", F.sum(F.expr("IF(upto IS NULL OR s > upto, 1, 0)")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("covered", F.expr(f"is_first AND coalesce(upto, s) >= (shard + 1) * {SHARD}L"))
    inner = inner.join(edge.filter("covered").select(*shard), shard, "left_anti").select(*names, "s", "e", "n", "next_s")
    edge = edge.groupBy(*names, "run").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.sum(F.expr("n + IF(covered, n_inside, 0L)")).alias("n"), F.max(F.struct("s", "next_s")).alias("tail")
    )
    after = F.lead("s").over(Window.partitionBy(*names).orderBy("s"))
    # the run that follows lies in the shard of the last member, or else it is the next edge run
    edge = edge.select(*names, "s", "e", "n", F.coalesce(F.col("tail.next_s"), after).alias("next_s"))
    return inner.unionByName(edge)


def merged_periods(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``s``, ``e``, ``n`` (members) of the periods of the intervals [s, e) with known keys and ``s < e``."""
    valid = " AND ".join([f"{k} IS NOT NULL" for k in keys] + ["s < e"])
    return _periods(intervals.select(*keys, "s", "e").filter(valid), keys).drop("next_s")


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, min_members: int = 1, max_gap: int | None = None) -> DataFrame:
    """Periods and gaps of the intervals [``start``, ``end``) (bigint) of each entity of ``keys``.

    Intervals that overlap or touch form a period. Result: ``keys``, ``kind``, ``start_ms``, ``end_ms``: kind
    ``period`` for periods of at least ``min_members`` intervals, ``gap`` for the time between one period (of any
    size) and the next of the entity, if it is no longer than ``max_gap``. Rows with a null key, a null time or an
    end not after the start don't take part; repeated rows count as intervals of their own; an empty table gives an
    empty table. Other columns are not read. A single interval may have any length: it makes at most three pieces.
    """
    names = [f"k{j}" for j in range(len(keys))]
    valid = " AND ".join([f"{a} IS NOT NULL" for a in names] + ["s < e"])
    intervals = df.select(*[F.col(k).alias(a) for k, a in zip(keys, names)], F.col(start).alias("s"), F.col(end).alias("e")).filter(valid)
    both = _periods(intervals, names)
    gap = F.expr("next_s IS NOT NULL" + (f" AND next_s - e <= {int(max_gap)}L" if max_gap is not None else ""))
    out = F.array(
        F.when(F.col("n") >= min_members, F.struct(F.lit("period").alias("kind"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))),
        F.when(gap, F.struct(F.lit("gap").alias("kind"), F.col("e").alias("start_ms"), F.col("next_s").alias("end_ms"))),
    )
    return both.select(*[F.col(a).alias(k) for k, a in zip(keys, names)], F.inline(F.filter(out, lambda x: x.isNotNull())))
