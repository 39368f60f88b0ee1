"""The latest delivery of each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Of the rows of one ``key`` the one with the highest ``order``, with ``key`` and ``columns``.

    Equal ``order``: the row whose ``columns`` sort last (nulls first), so that the choice is the same on each run.
    A null ``order`` is older than any other. Rows with a null key name no record: exact repeats of them count
    once, all others stay. The limit of one row a key is applied before the shuffle too, so a key with very many
    deliveries sends one row a task. An empty table gives an empty table; other columns are not read.
    """
    payload = list(dict.fromkeys([*columns, order]))
    nameless = F.when(F.col(key).isNull(), F.xxhash64(*[F.col(c) for c in payload]))
    w = Window.partitionBy(F.col(key), F.col("__nameless")).orderBy(*[F.col(c).desc_nulls_last() for c in [order, *columns]])
    return (
        df.select(key, *[c for c in payload if c != key], nameless.alias("__nameless"))
        .withColumn("__rank", F.row_number().over(w))
        .filter("__rank = 1")
        .select(key, *[c for c in columns if c != key])
    )


def squeezed(text: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def finite(value: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def whole_ms(seconds: Column) -> Column:
    """Seconds as whole milliseconds; halves go away from zero, on the printed decimal."""
    return F.round(seconds * 1000.0).cast("bigint")
