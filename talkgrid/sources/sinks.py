"""Writers of the artefacts. Each writes a folder by Spark's commit protocol, so a failed job leaves no half table."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.operators.transcripts import readable
from talkgrid.schema import flat, with_segment_columns


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; nested columns as JSON."""
    flat(df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, without columns whose name starts with an underscore."""
    df.select(*[f"`{c}`" for c in df.columns if not c.startswith("_")]).write.mode("overwrite").json(path)


def write_segments(df: DataFrame, path: str) -> None:
    """Segments in their fixed columns as CSV and JSON lines, and a timeline of start, end and speaker."""
    rows = with_segment_columns(df)
    write_csv(rows, f"{path}/segments_csv")
    write_jsonl(rows, f"{path}/segments_jsonl")
    write_csv(rows.select("file_id", "start", "end", "speaker_id"), f"{path}/timeline_csv")


def write_transcript(segments: DataFrame, path: str) -> None:
    """Readable blocks in order of file and time, as text; files in the folder follow one another."""
    blocks = readable(segments).repartitionByRange("file_id", "s").sortWithinPartitions("file_id", "s", "idx")
    blocks.select(F.concat("block", F.lit("\n"))).write.mode("overwrite").text(path)


def write_events(events: DataFrame, path: str, enter: float, leave: float, median_k: int) -> None:
    """Sound events as CSV with fixed decimals: times three, scores four."""
    number = lambda c, n: F.format_string(f"%.{n}f", F.col(c) / (1000.0 if n == 3 else 1.0))
    rows = events.select(
        "file_id", number("s", 3).alias("start"), number("e", 3).alias("end"), "label", number("score", 4).alias("score"), F.lit("frames").alias("source"),
        F.lit(enter).alias("enter"), F.lit(leave).alias("exit"), F.lit(median_k).alias("median_k"),
    )
    rows.write.mode("overwrite").csv(path, header=True)


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """Parquet in folders by ``key``, a few files each: for reading single recordings without a scan of all."""
    df.repartition(key, F.pmod(F.xxhash64(*df.columns), F.lit(4))).write.mode("overwrite").partitionBy(key).parquet(path)


def report_html(metrics: dict, speakers: list[dict], moments: list[dict], transcript: list[dict], total: int) -> str:
    """A page on one recording from small results: numbers, speakers, moments, and as much of the transcript as is given of ``total`` rows."""
    e = lambda x: html.escape(str(x if x is not None else "n/a"))
    rows = "".join(f"<tr><th>{e(k)}</th><td>{e(v)}</td></tr>" for k, v in metrics.items())
    cards = "".join(f"<li>{e(s.get('speaker_name') or s.get('speaker_id'))}: {e(s.get('total_duration'))} s, {e(s.get('word_count'))} words</li>" for s in speakers)
    peaks = "".join(f"<li>{e(m.get('time'))} {e(m.get('speaker'))}: {e(m.get('text'))}</li>" for m in moments)
    lines = "".join(f"<p><b>{e(t.get('speaker'))}</b> {e(t.get('text'))}</p>" for t in transcript)
    more = f"<p>{total - len(transcript)} more segments</p>" if total > len(transcript) else ""
    return f"<!doctype html><meta charset=utf-8><title>Conversation</title><table>{rows}</table><ul>{cards}</ul><ul>{peaks}</ul>{lines}{more}"


def report_markdown(facts: dict, insights: list[str]) -> str:
    """A short narrative of one recording."""
    return "\n".join(["# Conversation report", "", *[f"- {k}: {v}" for k, v in facts.items()], "", "## Interaction", "", *[f"- {i}" for i in insights]]) + "\n"
