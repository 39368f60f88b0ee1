"""Functions of spoken text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Filler words and phrases of speech transcripts.
FILLERS = [
    "um", "uh", "erm", "er", "mm", "hmm", "like", "you know", "i mean", "sort of", "kinda", "right", "okay", "ok", "so", "well", "uhh", "umm", "basically",
    "literally", "actually", "totally", "absolutely", "definitely", "pretty much", "kind of", "you see", "let me see", "let's see", "anyway",
]
#: The phrases that are counted in the text; other fillers are counted as tokens, so phrases outside this list never are.
FILLER_PHRASES = ["you know", "i mean", "sort of", "kind of", "let me see", "let's see"]
#: Words whose repetition is no disfluency, marks of an abandoned start, pronouns that are restarted, and the hesitations of a restart.
NO_REPETITION = ["the", "a", "an", "to", "of", "in", "on", "at", "by"]
START_MARKS = [" - ", " -- ", "... "]
RESTARTED = ["i", "we", "they", "you", "he", "she", "it"]
HESITATIONS = ["um", "uh", "er"]
#: Endings that add a syllable.
ENDINGS = ["tion", "sion", "cial", "tial", "ious", "eous"]


def tokens(text: Column) -> Column:
    """Words of a transcript: letters and digits, with apostrophes and hyphens inside or behind; of single ones only i and a.

    Null has no words.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'-]*"), F.lit(0))
    return F.coalesce(F.filter(found, lambda w: (F.length(w) > 1) | w.isin("i", "a")), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Parts between white space (of any script); 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")), F.lit(0))


def content_words(text: Column) -> Column:
    """The distinct parts between white space of more than 3 signs, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: F.length(w) > 3))


def _count(text: Column, part: str) -> Column:
    """How often ``part`` is in ``text``, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("int")


def filler_count(words: Column, text: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    single = [f for f in FILLERS if " " not in f]
    phrases = sum((_count(padded, f" {p} ") for p in FILLER_PHRASES), F.lit(0))
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w.isin(*single))) + F.coalesce(phrases, F.lit(0))).otherwise(0)


def repetition_count(words: Column) -> Column:
    """A word again at once, or again after a filler or a word of one or two signs."""
    at = lambda i: F.get(words, i)
    n = F.size(words)
    once = F.filter(F.sequence(F.lit(0), n - 2), lambda i: (at(i) == at(i + 1)) & (F.length(at(i)) > 2) & ~at(i).isin(*NO_REPETITION))
    over = F.filter(F.sequence(F.lit(0), n - 4), lambda i: (at(i) == at(i + 2)) & (F.length(at(i)) > 3) & (at(i + 1).isin(*FILLERS) | (F.length(at(i + 1)) <= 2)))
    return F.when(n > 1, F.size(once)).otherwise(0) + F.when(n > 3, F.size(over)).otherwise(0)


def false_start_count(words: Column, text: Column) -> Column:
    """Marks of an abandoned start, restarted pronouns, and different words around a hesitation."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    marks = sum((_count(padded, m) for m in START_MARKS), F.lit(0)) + sum((_count(padded, f" {p} - {p} ") for p in RESTARTED), F.lit(0))
    at = lambda i: F.get(words, i)
    n = F.size(words)
    around = F.filter(F.sequence(F.lit(0), n - 4), lambda i: (F.length(at(i)) > 2) & (F.length(at(i + 2)) > 2) & (at(i) != at(i + 2)) & at(i + 1).isin(*HESITATIONS))
    return F.when(n > 0, F.coalesce(marks, F.lit(0)) + F.when(n >= 4, F.size(around)).otherwise(0)).otherwise(0)


def syllables(word: Column) -> Column:
    """Estimated syllables: vowel groups, less a silent e at the end, and one more for some endings; at least one."""
    w = F.regexp_replace(F.lower(word), r"^[.,!?;:]+|[.,!?;:]+$", "")
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = F.when(w.endswith("e") & (F.length(w) > 2) & (groups > 1), 1).otherwise(0)
    more = F.when(w.rlike("(" + "|".join(ENDINGS) + ")$"), 1).otherwise(0)
    return F.when(F.length(w) <= 1, 1).otherwise(F.greatest(F.lit(1), groups - silent + more))


def syllable_count(words: Column) -> Column:
    return F.aggregate(F.transform(words, syllables), F.lit(0), lambda a, b: a + b)


def clock(ms: Column) -> Column:
    """``hh:mm:ss`` of milliseconds, rounded to seconds with halves to even; ``--:--:--`` for null or negative."""
    total = F.bround(ms / 1000.0).cast("bigint")
    text = F.format_string("%02d:%02d:%02d", F.floor(total / 3600), F.floor(total / 60) % 60, total % 60)
    return F.when(ms.isNull() | (ms < 0), F.lit("--:--:--")).otherwise(text)


def spoken_clock(seconds: Column) -> Column:
    """``1h 02m 03s``, ``2m 03s`` or ``5s``; 0s for null."""
    t = F.greatest(F.lit(0), F.coalesce(F.bround(seconds).cast("bigint"), F.lit(0).cast("bigint")))
    h, m, s = F.floor(t / 3600), F.floor(t / 60) % 60, t % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))


def short_clock(seconds: Column) -> Column:
    """``1:02:03`` or ``2:03``; 0:00 for null or negative."""
    t = F.greatest(F.lit(0), F.coalesce(F.floor(seconds).cast("bigint"), F.lit(0).cast("bigint")))
    h, m, s = F.floor(t / 3600), F.floor(t / 60) % 60, t % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def fine_clock(ms: Column) -> Column:
    """``mm:ss.mmm``, or ``hh:mm:ss.mmm`` from an hour on."""
    t = F.greatest(F.lit(0).cast("bigint"), F.coalesce(ms.cast("bigint"), F.lit(0).cast("bigint")))
    h, m, s, x = F.floor(t / 3600000), F.floor(t / 60000) % 60, F.floor(t / 1000) % 60, t % 1000
    return F.when(h > 0, F.format_string("%02d:%02d:%02d.%03d", h, m, s, x)).otherwise(F.format_string("%02d:%02d.%03d", m, s, x))


def signed(value: Column) -> Column:
    """Two decimals with sign (halves away from zero), or n/a for null and NaN."""
    return F.when(value.isNull() | F.isnan(value), F.lit("n/a")).otherwise(F.format_string("%+.2f", F.round(value, 2)))


def display_name(name: Column, ident: Column) -> Column:
    """The name, or else "Speaker" and the id; "Unknown" without either."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("Speaker "), F.nullif(F.trim(ident), F.lit(""))), F.lit("Unknown"))
