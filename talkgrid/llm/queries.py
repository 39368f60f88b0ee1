"""Queries of the training-data operators over the project's tables, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.llm.bpe import count_tokens, decode_ids, encode_texts
from talkgrid.llm.digest import certified_percentiles
from talkgrid.llm.mixing import mix_sources
from talkgrid.llm.nearest import nearest_join
from talkgrid.llm.quality import text_statistics
from talkgrid.llm.topn import top_n_per_group
from talkgrid.operators.latest import finite, latest_rows, squeezed, whole_ms
from talkgrid.operators.skew import join_groups
from talkgrid.storage import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    events = latest_rows(spark.read.parquet(f"{sf}/events_timeline.parquet"), "event_id", "ingested_at", ["file_id", "label", "score"])
    events = events.withColumn("label", F.lower(squeezed(F.col("label")))).filter("label <> ''")
    return top_n_per_group(events, ["file_id", "label"], "score", "event_id", 3, decimals=4, unique=True)


SQL["p1_found"] = r"""
WITH latest AS (SELECT * FROM events_timeline QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC) = 1),
     clean AS (SELECT file_id, lower(regexp_replace(label, '^\s+|\s+$', '', 'g')) AS label, event_id, round(score, 4) AS s FROM latest
               WHERE score IS NOT NULL AND NOT isnan(score) AND file_id IS NOT NULL)
SELECT file_id, label, event_id FROM clean WHERE label <> ''
QUALIFY row_number() OVER (PARTITION BY file_id, label ORDER BY s DESC, event_id) <= 3
"""


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    def side(table: str, key: str) -> DataFrame:
        rows = latest_rows(spark.read.parquet(f"{sf}/{table}.parquet"), key, "ingested_at", ["file_id", "start"])
        return rows.filter(finite(F.col("start"))).select(key, "file_id", whole_ms(F.col("start")).alias("ms"))

    return nearest_join(side("events_timeline", "event_id"), side("segments", "seg_id"), ["file_id"], "event_id", "ms", "seg_id", "ms", 750)


SQL["p4_found"] = """
WITH e AS (SELECT * FROM events_timeline QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC) = 1),
     s AS (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY ingested_at DESC) = 1),
     l AS (SELECT event_id, file_id, round("start" * 1000)::BIGINT AS t FROM e WHERE NOT isnan("start")),
     r AS (SELECT file_id, round("start" * 1000)::BIGINT AS t, min(seg_id) AS seg_id FROM s WHERE NOT isnan("start") GROUP BY ALL),
     cells AS (SELECT *, unnest([t // 751 - 1, t // 751, t // 751 + 1]) AS cell FROM r)
SELECT seg_id, event_id FROM l JOIN cells ON l.file_id = cells.file_id AND l.t // 751 = cell AND abs(l.t - cells.t) <= 750
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(l.t - cells.t), cells.t, seg_id) = 1
"""


MEASURES = ["wpm", "f0_mean_hz"]
PERCENTILES = [0.1, 0.25, 0.5, 0.75, 0.9]


def _measures(spark: SparkSession, sf: str):
    """Values of the measures by speaker, written once; the speakers with a large part of them; the certified percentiles.

    Digests are built by the day on which a segment came in, and merged.
    """
    rows = latest_rows(spark.read.parquet(f"{sf}/segments.parquet"), "seg_id", "ingested_at", ["speaker_id", *MEASURES, "ingested_at"])
    pairs = F.inline(F.array(*[F.struct(F.lit(m).alias("field_name"), F.col(m).alias("x")) for m in MEASURES]))
    values = rows.filter(squeezed(F.col("speaker_id")) != "").select("seg_id", "speaker_id", F.to_date("ingested_at").alias("day"), pairs)
    space, keys = Workspace(spark), ["speaker_id", "field_name"]
    values = space.write(values.filter(finite(F.col("x")) & (F.col("x") > 0)), "values")
    found, heavy = certified_percentiles(values, keys, "x", "seg_id", "day", PERCENTILES, space)
    return values, heavy, found, keys


@query
def p5_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """The percentiles of each speaker, with the certified error of their ranks as a share of the values."""
    _, _, found, keys = _measures(spark, sf)
    return found.select(*keys, "n", *[F.col(f"p{j}").alias(f"p{round(p * 100)}") for j, p in enumerate(PERCENTILES)], "rank_error")


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    values, heavy, found, keys = _measures(spark, sf)
    bounds = found.select(*keys, F.col("p0").alias("p10"), F.col(f"p{len(PERCENTILES) - 1}").alias("p90"))
    return join_groups(values, bounds, keys, heavy).filter("x > 3 * p90 OR x < p10 / 3").select("seg_id", "field_name")


SQL["p5_found"] = """
WITH latest AS (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY ingested_at DESC) = 1),
     vals AS (SELECT seg_id, speaker_id, 'wpm' AS field_name, wpm AS x FROM latest UNION ALL
              SELECT seg_id, speaker_id, 'f0_mean_hz' AS field_name, f0_mean_hz AS x FROM latest),
     good AS (SELECT * FROM vals WHERE x > 0 AND NOT isnan(x) AND trim(speaker_id) <> ''),
     bounds AS (SELECT speaker_id, field_name, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.9) AS p90 FROM good GROUP BY ALL)
SELECT seg_id, field_name FROM good JOIN bounds USING (speaker_id, field_name) WHERE x > 3 * p90 OR x < p10 / 3
"""


@query
def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf}/documents.parquet"), "text", ["doc_id"])


@query
def p6_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that don't come back from their ids as they were: none, but for null texts, which come back empty."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    back = decode_ids(encode_texts(docs, "text", ["doc_id", "text"]).withColumnRenamed("text", "before"), "ids", ["doc_id", "before"])
    return back.groupBy().agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.coalesce("before", F.lit("")) != F.col("text")).alias("changed"))


SQL["p6_round_trip"] = "SELECT count(*) AS documents, 0::BIGINT AS changed FROM documents"


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    clean = F.lower(squeezed(F.col("source")))
    sizes = count_tokens(spark.read.parquet(f"{sf}/documents.parquet"), "text", ["doc_id", "source"]).withColumn("source", clean)
    targets = spark.read.parquet(f"{sf}/mix_targets.parquet").withColumn("source", clean)
    return mix_sources(sizes, targets, "doc_id", "source", "n_tokens")


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1].filter("short").select("source")


@query
def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


@query
def p7_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


@query
def p8_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return text_statistics(spark.read.parquet(f"{sf}/documents.parquet"), "text", ["doc_id"], spark.read.parquet(f"{sf}/common_words.parquet"))


@query
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_statistics(spark, sf).filter("NOT is_prose").select("doc_id")
