"""Slots for models: a function over Arrow batches where one is given, a documented neutral result where none is."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrid.functions.affect import INTENTS, SPEECH_EMOTIONS
from talkgrid.operators.speakers import EMOTIONS


def _only(labels: list[str], chosen: str) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[F.lit(1.0 if x == chosen else 0.0) for x in labels]))


def default_text_emotion() -> Column:
    """All 28 emotions, neutral 1."""
    return _only(EMOTIONS, "neutral")


def default_speech_emotion() -> Column:
    """All 8 emotions, neutral 1."""
    return _only(SPEECH_EMOTIONS, "neutral")


def default_intent() -> Column:
    """The first three intents, equally likely."""
    return F.map_from_arrays(F.array(*[F.lit(x) for x in INTENTS[:3]]), F.array(*[F.lit(1 / 3)] * 3))


def default_affect() -> Column:
    """Valence, arousal and dominance of 0."""
    return F.struct(F.lit(0.0).alias("valence"), F.lit(0.0).alias("arousal"), F.lit(0.0).alias("dominance"))


def with_model(df: DataFrame, out: str, default: Column, load: Callable[[], Callable[[pd.DataFrame], list]] | None = None, inputs: list[str] | None = None) -> DataFrame:
    """``df`` with ``out``: the results of a model for each row, or ``default``.

    ``load`` runs once in each worker and gives a function from a batch with ``inputs`` (all columns, if not given) to a list
    of results of the type of ``default``, one a row; None results become the default. Without ``load`` all rows have the default.
    """
    filled = df.withColumn(out, default)
    if load is None:
        return filled
    schema, names = filled.schema, inputs or df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            found = model(batch[names])
            if len(found) != len(batch):
                raise ValueError(f"the model gave {len(found)} results for {len(batch)} rows")
            yield batch.assign(**{out: [old if new is None else new for new, old in zip(found, batch[out])]})

    return filled.mapInPandas(run, schema)


def parse_durations(text: str | None) -> dict[str, float]:
    """Limits by label from ``a=0.5, b=1`` or a JSON object; labels in lower case. What isn't a number is an error."""
    import json

    text = (text or "").strip()
    if not text:
        return {}
    if text.startswith("{"):
        return {str(k).strip().lower(): float(v) for k, v in json.loads(text).items()}
    pairs = [re.split(r"\s*[=:]\s*", part.strip(), maxsplit=1) for part in text.split(",") if part.strip()]
    if any(len(p) != 2 for p in pairs):
        raise ValueError(f"no label and limit: {text}")
    return {k.lower(): float(v) for k, v in pairs}
