"""Queries of spoken and written text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.functions import text as X
from talkgrid.plans.registry import Registry
from talkgrid.sources.tables import SEG, segments

R = Registry()
_TOK = rf"""{SEG}, tk AS (SELECT file_id, idx, text, s, e, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''-]*'), lambda w: length(w) > 1 OR w IN ('i', 'a')) AS words FROM seg)"""


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf, ["text"]).select("file_id", "idx", "s", "e", "text", X.tokens(F.col("text")).alias("words"))


@R.add(f"WITH {_TOK} SELECT file_id, idx, (unnest(range(len(words))))::INTEGER AS pos, unnest(words) AS word FROM tk")
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select("file_id", "idx", F.posexplode("words").alias("pos", "word"))


_SINGLE = "[" + ", ".join("'" + f.replace("'", "''") + "'" for f in X.FILLERS if " " not in f) + "]"
_ALL = "[" + ", ".join("'" + f.replace("'", "''") + "'" for f in X.FILLERS) + "]"


def _sql_count(parts: list[str]) -> str:
    quoted = [p.replace("'", "''") for p in parts]
    return " + ".join(f"(length(pad) - length(replace(pad, '{q}', ''))) // {len(p)}" for p, q in zip(parts, quoted))


@R.add(
    f"""WITH {_TOK}, p AS (SELECT *, ' ' || lower(coalesce(text, '')) || ' ' AS pad, len(words) AS n FROM tk)
SELECT file_id, idx,
 CASE WHEN n > 0 THEN len([w for w in words if list_contains({_SINGLE}, w)]) + {_sql_count([f" {q} " for q in X.FILLER_PHRASES])} ELSE 0 END::INTEGER AS fillers,
 (len([i for i in range(1, n) if words[i] = words[i + 1] AND length(words[i]) > 2 AND words[i] NOT IN ({", ".join(repr(w) for w in X.NO_REPETITION)})])
  + len([i for i in range(1, n - 2) if words[i] = words[i + 2] AND length(words[i]) > 3 AND (list_contains({_ALL}, words[i + 1]) OR length(words[i + 1]) <= 2)]))::INTEGER AS repetitions,
 CASE WHEN n > 0 THEN {_sql_count(X.START_MARKS)} + {_sql_count([f" {q} - {q} " for q in X.RESTARTED])}
  + len([i for i in range(1, n - 2) if length(words[i]) > 2 AND length(words[i + 2]) > 2 AND words[i] <> words[i + 2] AND words[i + 1] IN ('um', 'uh', 'er')]) ELSE 0 END::INTEGER AS false_starts FROM p"""
)
def disfluency(spark: SparkSession, sf: str) -> DataFrame:
    w, t = F.col("words"), F.coalesce("text", F.lit(""))
    return _tokens(spark, sf).select("file_id", "idx", X.filler_count(w, t).cast("int").alias("fillers"), X.repetition_count(w).alias("repetitions"), X.false_start_count(w, t).cast("int").alias("false_starts"))


@R.add(
    rf"""WITH {_TOK}, v AS (SELECT file_id, idx, words, [len(regexp_extract_all(w, '[aeiouy]+')) for w in words] AS g FROM tk)
SELECT file_id, idx, coalesce(list_sum([CASE WHEN length(w) <= 1 THEN 1 ELSE greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' AND length(w) > 2 AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(w, '(tion|sion|cial|tial|ious|eous)$') THEN 1 ELSE 0 END) END for w in words]), 0)::INTEGER AS syllables FROM v"""
)
def syllables(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select("file_id", "idx", X.syllable_count(F.col("words")).alias("syllables"))


@R.add(
    rf"""WITH {SEG}, w AS (SELECT file_id, idx, e - s AS d, CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) END AS n FROM seg)
SELECT file_id, idx, n::INTEGER AS words, round(CASE WHEN d >= 500 THEN n / (d / 60000.0::DOUBLE) END, 6) AS wpm FROM w"""
)
def word_count_wpm(spark: SparkSession, sf: str) -> DataFrame:
    rows = segments(spark, sf, ["text"]).select("file_id", "idx", (F.col("e") - F.col("s")).alias("d"), X.word_count(F.col("text")).alias("words"))
    return rows.select("file_id", "idx", "words", F.round(F.expr("CASE WHEN d >= 500 THEN words / (d / 60000.0D) END"), 6).alias("wpm"))


@R.add(
    f"""WITH {SEG}, t AS (SELECT file_id, idx, s, e, round_even(s / 1000.0::DOUBLE, 0)::BIGINT AS a, s // 1000 AS f FROM seg)
SELECT file_id, idx, printf('%02d:%02d:%02d', a // 3600, a // 60 % 60, a % 60) AS clock,
 CASE WHEN a >= 3600 THEN printf('%dh %02dm %02ds', a // 3600, a // 60 % 60, a % 60) WHEN a >= 60 THEN printf('%dm %02ds', a // 60, a % 60) ELSE printf('%ds', a) END AS spoken,
 CASE WHEN f >= 3600 THEN printf('%d:%02d:%02d', f // 3600, f // 60 % 60, f % 60) ELSE printf('%d:%02d', f // 60, f % 60) END AS short,
 CASE WHEN s >= 3600000 THEN printf('%02d:%02d:%02d.%03d', s // 3600000, s // 60000 % 60, s // 1000 % 60, s % 1000) ELSE printf('%02d:%02d.%03d', s // 60000, s // 1000 % 60, s % 1000) END AS fine
FROM t WHERE s >= 0"""
)
def clock_formats(spark: SparkSession, sf: str) -> DataFrame:
    rows, sec = segments(spark, sf, []).filter("s >= 0"), F.col("s") / 1000.0
    return rows.select("file_id", "idx", X.clock(F.col("s")).alias("clock"), X.spoken_clock(sec).alias("spoken"), X.short_clock(sec).alias("short"), X.fine_clock(F.col("s")).alias("fine"))


@R.add(
    rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '[\s\x{{a0}}\x{{85}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x0b]+'), lambda x: x <> '')) END AS words, coalesce(length(text), 0) AS signs FROM documents)
SELECT lang, count(*) AS documents, sum(words)::BIGINT AS words, sum(signs)::BIGINT AS signs FROM d GROUP BY lang"""
)
def document_words(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(X.word_count(F.col("text")).cast("bigint")).alias("words"), F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).alias("signs")
    )
