"""Sequential operators: groups are sorted and read as a stream, with constant memory however long a group is.

Where a pause makes the state new, a file is cut into the stretches between such pauses, and a stretch is one task's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.operators.intervals import overlap_join
from talkgrid.operators.sequences import gap_merge
from talkgrid.storage import stored

#: Width of a join bucket of rows and stretches, in ms.
BUCKET = 600_000

Row = dict[str, Any]
_TURN = "file_id string, stretch bigint, idx bigint, speaker_id string, s bigint, e bigint"


def fold_groups(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, Row], list[Row]], end: Callable[[Any], list[Row]], schema: str) -> DataFrame:
    """Rows that ``step`` and ``end`` give for each group of ``keys``, read by ``order``.

    ``start`` makes the state of a group, ``step`` takes the state and a row, ``end`` the state behind the last row.
    Results need the columns of ``schema``, ``keys`` first. Only for semantics in which a row depends on the results
    of those before; one task reads a group, but holds only its state.
    """
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [part.strip().split(" ")[0].strip("`") for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            done: list[Row] = []
            columns = list(batch.columns)
            for values in zip(*[batch[c] for c in columns]):
                row = dict(zip(columns, values))
                now = tuple(row[k] for k in keys)
                if now != key:
                    if state is not None:
                        done += [dict(zip(keys, key)) | r for r in end(state)]
                    key, state = now, start()
                done += [dict(zip(keys, key)) | r for r in step(state, row)]
            yield pd.DataFrame(done, columns=names)
        if state is not None:
            yield pd.DataFrame([dict(zip(keys, key)) | r for r in end(state)], columns=names)

    return rows.mapInPandas(run, schema)


def with_stretch(rows: DataFrame, gap: int, start: str = "s", end: str = "e") -> DataFrame:
    """``rows`` with ``stretch``: where in its file the stretch begins to which a row belongs.

    Rows of one file are of one stretch if there is no time of more than ``gap`` between them in which no interval
    [``start``, ``end``] is open. Rows find theirs by file and time bucket, so a long file is spread.
    """
    rows = stored(rows)
    spans = gap_merge(rows.select("file_id", F.expr(start).alias("s"), F.expr(end).alias("e")), ["file_id"], gap)
    spans = spans.select("file_id", "s", (F.col("e") + 1).alias("e"))
    points = rows.select("file_id", F.struct(*rows.columns).alias("row"), F.expr(start).alias("s"), F.expr(f"{start} + 1").alias("e"))
    return overlap_join(points, spans, ["file_id"], BUCKET, ("l", "r")).select("l.row.*", F.col("r.s").alias("stretch"))


def pack_batches(segments: DataFrame, longest: int = 8_000, most_ms: int = 300_000, most: int = 50, threshold: int = 12) -> DataFrame:
    """Batches of short segments, filled in order: ``file_id``, ``idx``, ``batch`` (null for segments that stay alone).

    A batch ends where the next segment would exceed ``most_ms`` or ``most``. Segments over ``longest`` stay alone, and
    so do all of a file with fewer than ``threshold`` segments.
    """
    counts = segments.groupBy("file_id").agg(F.count("*").alias("n"))
    rows = segments.select("file_id", "idx", "s", "e").join(counts, "file_id")

    def start() -> dict:
        return {"batch": -1, "ms": 0, "n": 0}

    def step(state: dict, row: Row) -> list[Row]:
        d = row["e"] - row["s"]
        if row["n"] < threshold or d > longest:
            return [{"idx": row["idx"], "batch": None}]
        if state["batch"] < 0 or state["ms"] + d > most_ms or state["n"] >= most:
            state.update(batch=state["batch"] + 1, ms=0, n=0)
        state.update(ms=state["ms"] + d, n=state["n"] + 1)
        return [{"idx": row["idx"], "batch": state["batch"]}]

    return fold_groups(rows, ["file_id"], ["s", "idx"], start, step, lambda state: [], "file_id string, idx bigint, batch int")


def resolve_overlaps(segments: DataFrame, least: int = 50) -> DataFrame:
    """Segments cut where they overlap the one before, both at the middle of the overlap; shorter ones than ``least`` go.

    The cut moves the end of the one before, so chains of overlaps depend on their order.
    """

    def start() -> dict:
        return {"last": None}

    def step(state: dict, row: Row) -> list[Row]:
        s, e, out = max(0, row["s"]), max(max(0, row["s"]) + least, row["e"]), []
        last = state["last"]
        if last and s < last["e"]:
            last["e"] = s = (last["e"] + s) // 2
        if e - s >= least:
            if last:
                out.append(last)
            state["last"] = {"idx": row["idx"], "speaker_id": row["speaker_id"], "s": s, "e": e}
        return out

    first = "greatest(0L, s)"
    rows = with_stretch(segments.select("file_id", "idx", "speaker_id", "s", "e"), 0, first, f"greatest({first} + {least}, e)")
    return fold_groups(rows, ["file_id", "stretch"], ["s", "idx"], start, step, lambda state: [state["last"]] if state["last"] else [], _TURN).drop("stretch")


def absorb_short(segments: DataFrame, least: int, gap: int) -> DataFrame:
    """Turns with those under ``least`` ms absorbed by a neighbour of the same speaker within ``gap``, the earlier one first.

    What finds no neighbour stays.
    """

    def start() -> dict:
        return {"last": None, "now": None}

    def place(state: dict, cur: Row, nxt: Row | None) -> list[Row]:
        last = state["last"]
        if cur["e"] - cur["s"] < least:
            if last and last["speaker_id"] == cur["speaker_id"] and max(0, cur["s"] - last["e"]) <= gap:
                last["e"] = max(last["e"], cur["e"])
                return []
            if nxt and nxt["speaker_id"] == cur["speaker_id"] and max(0, nxt["s"] - cur["e"]) <= gap:
                nxt["s"] = min(nxt["s"], cur["s"])
                return []
        state["last"] = cur
        return [last] if last else []

    def step(state: dict, row: Row) -> list[Row]:
        nxt = {k: row[k] for k in ("idx", "speaker_id", "s", "e")}
        out = place(state, state["now"], nxt) if state["now"] else []
        state["now"] = nxt
        return out

    def end(state: dict) -> list[Row]:
        out = place(state, state["now"], None) if state["now"] else []
        return out + ([state["last"]] if state["last"] else [])

    rows = with_stretch(segments.select("file_id", "idx", "speaker_id", "s", "e"), gap)
    return fold_groups(rows, ["file_id", "stretch"], ["s", "idx"], start, step, end, _TURN).drop("stretch")


def active_speakers(windows: DataFrame) -> DataFrame:
    """Who speaks from when to when, by a sweep over windows of speakers (``file_id``, ``s``, ``e``, ``speaker_id``).

    Between two borders the speaker with most open windows speaks (of equal ones the first by name); slices of the same
    speaker that touch are one. A speaker stays open until his last window ends. The state is the open windows only.
    """
    rows = with_stretch(windows.select("file_id", "speaker_id", "s", "e").filter("e > s"), 0)
    borders = rows.select("file_id", "stretch", "speaker_id", F.inline(F.expr("array(named_struct('t', s, 'd', 1), named_struct('t', e, 'd', -1))")))

    def start() -> dict:
        return {"open": {}, "t": None, "last": None}

    def step(state: dict, row: Row) -> list[Row]:
        out, open_now = [], state["open"]
        if open_now and row["t"] > state["t"]:
            who = min(open_now, key=lambda k: (-open_now[k], k))
            last = state["last"]
            if last and last["speaker_id"] == who and last["e"] == state["t"]:
                last["e"] = row["t"]
            else:
                if last:
                    out.append(last)
                state["last"] = {"speaker_id": who, "s": state["t"], "e": row["t"]}
        state["t"] = row["t"]
        n = open_now.get(row["speaker_id"], 0) + row["d"]
        open_now[row["speaker_id"]] = n
        if n <= 0:
            open_now.pop(row["speaker_id"])
        return out

    schema = "file_id string, stretch bigint, speaker_id string, s bigint, e bigint"
    return fold_groups(borders, ["file_id", "stretch"], ["t", "d", "speaker_id"], start, step, lambda state: [state["last"]] if state["last"] else [], schema).drop("stretch")
