"""Functions of affect scores, as column expressions. Scores are maps from label to double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The labels of speech emotions and of intents, in their order.
SPEECH_EMOTIONS = ["neutral", "happy", "sad", "angry", "fearful", "disgusted", "surprised", "calm"]
INTENTS = [
    "question", "request", "instruction", "command", "complaint", "apology", "opinion", "agreement", "disagreement", "suggestion", "status_update",
    "small_talk", "gratitude", "greeting", "farewell",
]
#: Limits under which an emotion is of low confidence: least best score, least margin, most normalised entropy.
LOW_CONFIDENCE = (0.55, 0.18, 0.85)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(values: Column) -> Column:
    """Softmax of an array; empty for an empty one."""
    shifted = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(shifted, lambda x: x / _sum(shifted))


def entropy(scores: Column) -> Column:
    """Entropy in nats of the positive scores, which aren't normalised first."""
    return -_sum(F.transform(F.filter(F.map_values(scores), lambda x: _finite(x) & (x > 0)), lambda x: x * F.ln(x)))


def normalized_entropy(scores: Column) -> Column:
    """Entropy as a part of the largest possible; 0 with fewer than two positive scores."""
    n = F.size(F.filter(F.map_values(scores), lambda x: _finite(x) & (x > 0)))
    return F.when(n > 1, entropy(scores) / F.ln(n)).otherwise(0.0)


def _descending(scores: Column) -> Column:
    return F.sort_array(F.filter(F.map_values(scores), _finite), asc=False)


def top_margin(scores: Column) -> Column:
    """Distance of the two best scores; the score itself if there is one, 0 if none."""
    v = _descending(scores)
    return F.when(F.size(v) > 1, F.get(v, F.lit(0)) - F.get(v, F.lit(1))).otherwise(F.coalesce(F.get(v, F.lit(0)), F.lit(0.0)))


def low_confidence(scores: Column) -> Column:
    """Whether the best score, the margin or the entropy of emotion scores says that they aren't sure; so without scores."""
    best, margin, most = LOW_CONFIDENCE
    v = _descending(scores)
    return F.coalesce((F.get(v, F.lit(0)) < best) | (top_margin(scores) < margin) | (normalized_entropy(scores) > most), F.lit(True))


def canonical_label(label: Column, labels: list[str]) -> Column:
    """The label of the list in any case, else the first of the list."""
    out = None
    for known in labels:
        hit = F.lower(label) == known.lower()
        out = F.when(hit, known) if out is None else out.when(hit, known)
    return out.otherwise(labels[0])


def normalize_scores(scores: Column, labels: list[str]) -> Column:
    """Scores of all ``labels``, adding up to 1: unknown labels count as the first, of several for one the last counts.

    Scores that are negative or not finite don't count; if all are 0 the first label has 1.
    """
    entries = F.filter(F.map_entries(scores), lambda e: _finite(e["value"]) & (e["value"] >= 0))
    named = F.transform(entries, lambda e: F.struct(canonical_label(e["key"], labels).alias("label"), e["value"].alias("value")))

    def last(k: str) -> Column:
        own = F.transform(F.filter(named, lambda e: e["label"] == k), lambda e: e["value"])
        return F.coalesce(F.element_at(F.concat(F.array(F.lit(0.0)), own), -1), F.lit(0.0))

    values = F.array(*[last(k) for k in labels])
    total = _sum(values)
    safe = F.when(total > 0, F.transform(values, lambda x: x / total)).otherwise(F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(len(labels))]))
    return F.map_from_arrays(F.array(*[F.lit(k) for k in labels]), safe)


def top_k(scores: Column, k: int) -> Column:
    """The ``k`` best (label, score) of a map; of equal scores the first by label. Scores that aren't finite don't count."""
    entries = F.filter(F.map_entries(scores), lambda e: _finite(e["value"]))
    order = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("d"), e["key"].alias("label"), e["value"].alias("score"))))
    return F.transform(F.slice(order, 1, k), lambda e: F.struct(e["label"].alias("label"), e["score"].alias("score")))


def intent_tag(intent: Column) -> Column:
    """An intent as a tag: lower case with hyphens; status for ``status_update`` and blank."""
    clean = F.replace(F.lower(F.trim(F.coalesce(F.nullif(intent, F.lit("")), F.lit("status_update")))), F.lit(" "), F.lit("_"))
    tag = F.replace(F.when(clean == "status_update", "status").otherwise(clean), F.lit("_"), F.lit("-"))
    return F.coalesce(F.nullif(tag, F.lit("")), F.lit("status"))


def pipeline_hint(valence: Column, arousal: Column, intent: Column) -> Column:
    """The coarser hint: agitated-negative, calm-positive or neutral with the intent as it is; neutral-status without values."""
    return (
        F.when(valence.isNull() | arousal.isNull(), "neutral-status")
        .when((arousal > 0.5) & (valence < 0), "agitated-negative")
        .when((arousal < 0.3) & (valence > 0.2), "calm-positive")
        .otherwise(F.concat(F.lit("neutral-"), F.coalesce(intent, F.lit("None"))))
    )


def analyzer_hint(valence: Column, arousal: Column, intent: Column) -> Column:
    """The finer hint, which also knows bright and low moods; the intent as a tag."""
    tag = intent_tag(intent)
    return (
        F.when(valence.isNull() | arousal.isNull() | F.isnan(valence) | F.isnan(arousal), F.concat(F.lit("neutral-"), tag))
        .when((arousal > 0.55) & (valence < 0), "agitated-negative")
        .when((arousal < 0.30) & (valence > 0.25), "calm-positive")
        .when(valence > 0.50, F.concat(F.lit("bright-"), tag))
        .when(valence < -0.35, F.concat(F.lit("low-"), tag))
        .otherwise(F.concat(F.lit("neutral-"), tag))
    )
