"""One run over many recordings: clean tables in, artefacts out."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from talkgrid.operators import conversation as C
from talkgrid.operators import overlap as O
from talkgrid.operators import rules as U
from talkgrid.operators import sound as D
from talkgrid.operators import speakers as S
from talkgrid.sources import sinks
from talkgrid.sources.tables import events, segments
from talkgrid.storage import Workspace


def run(spark: SparkSession, sf: str, out: str) -> list[str]:
    """Computes and writes every artefact of the recordings in ``sf`` to folders in ``out``; gives the folders' names.

    The clean segments and events are written once and read by all; each artefact is one job, and a job that is
    repeated overwrites its folder.
    """
    space = Workspace(spark)
    seg = space.write(segments(spark, sf), "segments")
    ev = space.write(events(spark, sf), "events")
    pairs = space.write(O.pairs(seg), "pairs")
    attributed = space.write(D.attributed(seg, ev), "attributed")
    metrics = C.conversation_metrics(seg).join(C.topic_coherence(seg), "file_id")
    named = seg.withColumn("start", F.col("s") / 1000.0).withColumn("end", F.col("e") / 1000.0)
    jobs = {
        "conversation_metrics": metrics, "energy_flow": C.energy_flow(seg), "overlap_summary": O.overlap_summary(seg), "interruption_events": O.interruptions(pairs),
        "interruptions_by_speaker": O.interruption_fold(pairs), "speakers_summary": S.rollup(seg, O.interruption_fold(pairs)), "moments_to_review": U.moments_to_review(seg),
        "segment_events": D.top_events(attributed), "segment_snr": D.snr_from_events(attributed, seg), "sound_summary": D.timeline_summary(ev), "insights": U.insights(metrics),
        "voice_risks": U.voice_risks(seg),
    }
    for name, df in jobs.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    sinks.write_segments(named, f"{out}/segments")
    sinks.write_transcript(seg, f"{out}/transcript")
    sinks.write_events(ev, f"{out}/events", 0.34, 0.18, 5)
    return [*jobs, "segments", "transcript", "events"]
