"""Problem 8: text quality statistics of documents, and which documents are not natural prose.

Method: statistics of words, signs and lines, extended by repetition (shares of repeated lines and paragraphs, and
coverage by the dominant n-gram); prose is told from lists, tables, boilerplate and junk by rules that combine them.

Each line is a sentence-like unit, a list item, a table row or without words; wrapped lines are joined first. A
document whose characters are mostly in list items and table rows isn't prose. What looks like sentences must also be
language: a public tokenizer for many languages, which was made of real text, cuts real words into clearly fewer
tokens than the same letters in another order. Random or scrambled letters need as many either way, in any script.

Everything is a function of one text, in linear time: a verdict hangs on no other row, and no row leaves its partition.
What hangs on a piece between white space alone (its words, ends of clauses and tokens) is looked up, not matched again:
no word, token or run of signs goes beyond such a piece, so the sums over pieces are those of the whole text.
"""

from __future__ import annotations

import base64
import functools
import operator
import random
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from talkgrid.llm.bpe import FOLDER, PATTERN

#: The public vocabulary by which words are told from letters in another order, how many other orders are tried, and the
#: least letters of a word that counts.
VOCABULARY, SHUFFLES, LEAST_WORD = "byte_bpe_multi_50k.tiktoken", 3, 3
#: A script counts if the vocabulary has so many tokens of two or more of its letters.
LEAST_KNOWN = 60
#: Words, and pieces between white space of up to so many signs, of which a worker remembers what was found; no result hangs on it.
REMEMBERED, LONGEST_REMEMBERED = 300_000, 40

#: Limits of the rules. A prose document has at least this share of its characters in sentences,
LEAST_PROSE = 0.5
#: or, where it has ``FRAME`` times as many items and rows as sentences (a list in a frame of a sentence or two), this;
FRAMED_PROSE, FRAME = 0.75, 3
#: this share of letters among its signs, words of this mean length, and at most this share of the tokens of its letters
#: in another order (less by the second value over the number of words);
LEAST_LETTERS, WORD_LENGTH, MOST_TOKENS = 0.6, (2.2, 20.0), (0.92, 0.3)
#: at most this share of common words (more is function words in no order), and of the most frequent phrase of up to
#: ``PHRASE`` words; both only count from so many words on.
MOST_COMMON, MOST_REPEATED, PHRASE, LEAST_WORDS = 0.85, 0.6, 4, 12
#: From so many words on the share of tokens counts. A text whose letters are mostly of this block is an encoded one.
LEAST_JUDGED, ENCODED = 5, (0x100, 0x250)

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_TOKEN = re.compile(r"\w+(?:['’.,:\-]\w+)*")
_QUOTE = re.compile(r"\s*(?:>+\s*)+")
_MARK = re.compile(r"<\|[\w ]*\|>")
_TIME = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?"
_STAMP = re.compile(rf"\s*[\[(]?{_TIME}(?:\s*(?:-->|->|[-–—])\s*{_TIME})?[\])]?\s*")
_SPEAKER = re.compile(r"\s*(?:<[^<>\n]{1,30}>\s*|[^\W\d_][\w .'’-]{0,28}?\s?(?::|\s[-–—])\s+)")
_BULLET = re.compile(r"\s*(?:[-*+•·‣▪◦–—→»]|->|=>|\[[ xX✓✗]?\]|[☐☑✓✔]|\(?\d{1,3}[.)]|\(?[^\W\d_][.)])\s+|\s*#(?=\w)")
_LETTER_BULLET = re.compile(r"\s*o\s+(?=\S)")
_HEADING = re.compile(r"\s*#{1,6}\s+\S")
_ENDS = re.compile(r"[.!?…。！？؟]['\"”’»)\]]*\s*(?:\(\s*[\d.,:]+\s*s?\s*\)\s*)?$")
_STOPS, _CLOSERS = frozenset(".!?…。！？؟"), frozenset("'\"”’»)]")
_CLAUSES = re.compile(r"[.!?…;:,|()\[\]。！？、，؟،]+(?:\s|$)|[。！？、，]")
_PAIRS_OF_KEY = re.compile(r"(?:^|[\s,;&])[\w.-]+=\S")
_COMMA_CELL = re.compile(r"""[;,]\s""")
_BLANK_LINES = re.compile(r"\n\s*\n")
_CSV = re.compile(r""",(?=[^\s"”’'»])|(?<=,),""")
_COLUMNS = re.compile(r" {2,}|\t")
#: Scripts written without spaces between words; two signs count as a word.
UNSPACED = ((0x0E00, 0x0EFF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF))
_UNSPACED = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED) + "]")


#: Code points from here on (rare ideographs, in the main) count as unspaced letters.
_TOP = 0x20000
_LETTER, _DIGIT, _BLANK, _ENCODED, _DENSE = 1, 2, 4, 8, 16


def _tables() -> np.ndarray:
    """By code point: the kinds of a sign as bits."""
    kind = np.zeros(_TOP + 1, np.uint8)
    for p, c in enumerate(map(chr, range(_TOP))):
        kind[p] = _LETTER * c.isalpha() | _DIGIT * (c.isalnum() and not c.isalpha()) | _BLANK * c.isspace()
    kind[ENCODED[0] : ENCODED[1]] |= _ENCODED
    for first, last in UNSPACED:
        kind[first : last + 1] |= _DENSE
    kind[_TOP] = _LETTER | _DENSE
    return kind


_KIND = _tables()
_ASCII = _KIND[:256].tobytes()
#: By bit, which kinds have it.
_HAS = np.array([[bool(k & bit) for k in range(32)] for bit in (_LETTER, _DIGIT, _BLANK, _ENCODED, _DENSE)], np.int64)


def code_points(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), _TOP)


def signs_of(text: str) -> list[int]:
    """The number of letters, digits, blanks, letters of ``ENCODED`` and letters of ``UNSPACED`` in ``text``."""
    kinds = np.frombuffer(text.encode().translate(_ASCII), np.uint8) if text.isascii() else _KIND[code_points(text)]
    return (_HAS @ np.bincount(kinds, minlength=32)).tolist()


class Memo(dict):
    """The values of a function of a piece of text alone, as far as remembered."""

    def __init__(self, function: Callable[[str], Hashable]):
        super().__init__()
        self.function = function

    def __missing__(self, piece: str):
        value = self.function(piece)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = value
        return value


@functools.lru_cache(1000)
def orders(length: int) -> list[operator.itemgetter]:
    """Orders of so many letters (two at least) as they come from a fixed seed."""
    rnd = random.Random(length)
    return [operator.itemgetter(*rnd.sample(range(length), length)) for _ in range(SHUFFLES)]


class Words:
    """What is known of a word from itself alone; one for each Python worker, which remembers the words it saw."""

    _run = re.compile(r"[^\W\d_]{%d,}" % LEAST_WORD)

    def __init__(self, folder: str, common: dict[str, int]):
        import tiktoken

        with open(f"{folder}/{VOCABULARY}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding(VOCABULARY, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        scripts: Counter = Counter()
        for token in ranks:
            text = token.decode("utf-8", "ignore").strip()
            if len(text) >= 2 and text.isalpha():
                scripts[self.script(text[0])] += 1
        self.known = {name for name, n in scripts.items() if n >= LEAST_KNOWN}
        self.common = common
        self.languages = range(max(common.values(), default=0).bit_length())
        self.number: dict[str, int] = {}
        self.rows = np.zeros((1024, 5 + len(self.languages)), np.int64)

    @staticmethod
    def script(letter: str) -> str:
        return unicodedata.name(letter, "?").split()[0]

    def learn(self, word: str) -> list[int]:
        """Tokens of the runs of letters in ``word`` (of scripts that count), those of the same letters in ``SHUFFLES`` other
        orders, and the number of runs; then, but for a word that begins with a digit, its length, 1, and 1 for each language
        in which it is common."""
        own = other = runs = 0
        for run in self._run.findall(word):
            if self.script(run[0]) in self.known:
                own, runs = own + len(self.encode(" " + run)), runs + 1
                other += len(self.encode("".join(" " + "".join(order(run)) for order in orders(len(run)))))
        if word[0].isdigit():
            return [own, other, runs, 0, 0, *(0 for _ in self.languages)]
        mask = self.common.get(word, 0)
        return [own, other, runs, len(word), 1, *(mask >> k & 1 for k in self.languages)]

    def sums(self, times: Counter) -> list[int]:
        """The sums of what is known of words that occur so many times each."""
        if len(self.number) >= REMEMBERED:
            self.number.clear()
        number = self.number
        for word in [w for w in times if w not in number]:
            n = len(number)
            if n == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[n] = self.learn(word)
            number[word] = n
        at = np.fromiter(map(number.__getitem__, times), np.intp, len(times))
        return (np.fromiter(times.values(), np.int64, len(times)) @ self.rows[at]).tolist()


@functools.cache
def words_of(folder: str, common: tuple[tuple[str, int], ...]) -> Words:
    return Words(folder, dict(common))


#: Bits of a count in ``_read``; no text has more signs.
_BITS = 31
_MOST = (1 << _BITS) - 1


def _read(piece: str) -> tuple[int, tuple[str, ...]]:
    """The number of words, ends of clauses and unspaced signs of ``piece`` as one, and its tokens."""
    counts = len(_WORD.findall(piece)), len(_CLAUSES.findall(piece)), 0 if piece.isascii() else len(_UNSPACED.findall(piece))
    return sum(n << _BITS * i for i, n in enumerate(counts)), tuple(_TOKEN.findall(piece.lower()))


_READ = Memo(_read)
_COUNT, _TOKENS = operator.itemgetter(0), operator.itemgetter(1)


def _counts(text: str) -> tuple[int, int]:
    """The number of words in ``text``, and of ends of clauses."""
    found = sum(map(_COUNT, map(_READ.__getitem__, text.split())))
    return (found & _MOST) + (found >> 2 * _BITS) // 2, found >> _BITS & _MOST


def _tokens(pieces: list[str]) -> list[str]:
    return list(chain.from_iterable(map(_TOKENS, map(_READ.__getitem__, pieces))))


def _words(text: str) -> int:
    return _counts(text)[0]


def _ends(text: str) -> bool:
    """Whether ``text`` ends a sentence, as ``_ENDS`` tells it; most texts by their last sign."""
    last = text.rstrip()[-1:]
    return last in _STOPS or last in _CLOSERS and bool(_ENDS.search(text))


def _is_row(line: str) -> bool:
    """Whether a line is a row of a table or a record: cells of a few words between separators, JSON, or key=value."""
    s = line.strip()
    if len(s) > 1 and s[0] in "{[" and s[-1] in "}]" and ":" in s:
        return True
    if s.count("=") > 1 and len(_PAIRS_OF_KEY.findall(s)) >= 2:
        return True
    for mark, cells, most in (("|", "|", 6), ("\t", "\t", 6), (";", ";", 6), (",", _CSV, 6), ("  ", _COLUMNS, 5)):
        if s.count(mark) < 2 or (mark == "," and s.count(",") - s.count(", ") < 2):
            continue
        parts = s.split(cells) if isinstance(cells, str) else cells.split(s)
        if len(parts) >= 3 and max(len(p.split()) for p in parts) <= most:
            if mark in ";," and len(_COMMA_CELL.findall(s)) > 1:
                continue
            return True
    return False


def _joined(lines: list[str]) -> list[str]:
    """The lines of a wrapped paragraph as one; other lines as they are.

    Lines are wrapped if the first word of the next one wouldn't have fitted, for most of those that don't end a
    sentence (which may end a paragraph too); or if most have the same number of words, four or more. Verse is one as
    well: half of the lines end with a comma or the like, the last with the sentence, and they have five words or more.
    """
    if len(lines) < 3:
        return lines
    lengths = sorted(map(len, lines))
    width = lengths[int(0.7 * (len(lines) - 1))]
    words = [len(x.split()) for x in lines]
    if sum(x[-1] in ",;:" for x in lines) >= 0.5 * len(lines) and lines[-1][-1] in ".!?" and sum(words) >= 5 * len(lines):
        return [" ".join(lines)]
    if sum(x[-1] in ".;,:!?)" for x in lines) > 0.6 * len(lines) or sum(words) < 4 * len(lines):
        return lines
    if words.count(usual := max(set(words), key=words.count)) >= 0.75 * len(lines) and usual >= 4:
        return [" ".join(lines)]
    if width < 24:
        return lines
    open_ended = [(a, b) for a, b in zip(lines, lines[1:]) if a[-1] not in ".!?"]
    full = sum(len(a) + 1 + len(b.split(None, 1)[0]) > width for a, b in open_ended)
    return [" ".join(lines)] if len(open_ended) >= 0.4 * len(lines) and full >= 0.75 * len(open_ended) else lines


def units(lines: list[str]) -> list[tuple[str, str]]:
    """``lines`` as (kind, text): ``prose``, ``list``, ``table``, ``signs`` (no words), ``head`` or ``mark`` (neutral)."""
    lines = [_MARK.sub(" ", x) if "<|" in x else x for x in lines]
    letter_bullets: list[bool] = []
    out: list[tuple[str, str]] = []
    plain: list[str] = []

    def is_letter_bullet(line: str):
        if not letter_bullets:
            letter_bullets.append(sum(x.lstrip()[:2] == "o " for x in lines) >= 3)
        return letter_bullets[0] and _LETTER_BULLET.match(line)

    def settle(unit: str) -> None:
        (n, clauses), ends = _counts(unit), _ends(unit)
        if n <= 5:
            kind = "list" if n else "signs"
        else:
            clauses = max(1, clauses + (not ends))
            few = n <= 7 and not ends
            short = n / clauses < 3.6 if ends else n / clauses < (4.6 if clauses >= 4 else 4.2)
            kind = "list" if few or (clauses >= (4 if ends else 3) and short) else "prose"
        out.append((kind, unit))

    def flush() -> None:
        if plain:
            for unit in _joined(plain):
                settle(unit)
            plain.clear()

    for line in lines:
        bare = line.lstrip()
        if not bare:
            flush()
            continue
        if bare[0] == ">":
            line = line[_QUOTE.match(line).end() :]
            bare = line.lstrip()
        first = bare[:1]
        if first == "#" and _HEADING.match(line):
            flush()
            out.append(("head", line))
            continue
        if _is_row(line):
            flush()
            out.append(("table", line))
            continue
        letter = first.isalpha()
        stamp = None if letter else _STAMP.match(line)
        body = line[stamp.end() :] if stamp else line
        head = body.lstrip()[:40]  # more than a speaker's name can be long
        speaker = _SPEAKER.match(body) if ":" in head or "-" in head or first == "<" or "–" in head or "—" in head else None
        if speaker:
            flush()
            said = body[speaker.end() :]
            if _words(said) > 3:
                settle(said)
            else:
                out.append(("list", line))
            continue
        if stamp:
            flush()
            if _words(body) <= 3:
                out.append(("mark", line))
            else:
                settle(body)
            continue
        second = bare[1:2]
        bullet = _BULLET.match(line) if not letter or second in (".", ")") else first == "o" and second.isspace() and is_letter_bullet(line)
        if bullet:
            flush()
            item = line[bullet.end() :]
            out.append(("prose", item) if _words(item) >= 7 and _ends(item) else ("list", line))
            continue
        stripped = line.strip()
        if stripped:
            plain.append(stripped)
    flush()
    return out


def _repeated(parts: list[str]) -> float:
    return 1 - len(set(parts)) / len(parts) if parts else 0.0


def phrase_coverage(tokens: list[str], counts: Counter) -> float:
    """Share of the characters that lie in the most frequent phrase of 1 to ``PHRASE`` words (it must occur 4 times).

    ``counts`` are those of ``tokens``. Only words that occur 4 times themselves can be in such a phrase. Of equally
    frequent phrases of so many words the longest counts.
    """
    words = [t for t, n in counts.items() if n >= 4]
    if not words:
        return 0.0
    total, base = sum(map(len, tokens)), len(words)
    n = max(counts.values())
    best = n * max(len(t) for t in words if counts[t] == n)
    often = dict(zip(words, range(base)))
    exact = np.int64 if base**PHRASE < 1 << 63 else object
    codes = ids = np.fromiter(map(often.get, tokens, repeat(-1)), exact, len(tokens))
    inside = known = ids >= 0
    for k in range(2, PHRASE + 1):
        inside, codes = inside[:-1] & known[k - 1 :], codes[:-1] * base + ids[k - 1 :]
        found = codes[inside]
        found.sort()
        if len(found) < 4 or not (found[3:] == found[:-3]).any():
            break  # no phrase occurs 4 times, and longer ones are no more frequent
        times = Counter(found.tolist())
        n = max(times.values())
        for code in [c for c, m in times.items() if m == n]:
            length = 0
            for _ in range(k):
                length, code = length + len(words[code % base]), code // base
            best = max(best, n * length)
    # a phrase of one word over and over overlaps itself
    return min(1.0, best / total)


#: Columns of ``text_statistics`` besides those kept.
FIELDS = {
    "n_words": "bigint", "mean_word_length": "double", "symbol_ratio": "double", "letter_share": "double", "ending_line_share": "double",
    "common_word_share": "double", "repeated_line_share": "double", "repeated_paragraph_share": "double", "phrase_coverage": "double",
    "prose_share": "double", "list_share": "double", "table_share": "double", "token_share": "double", "is_prose": "boolean",
}


def statistics(text: str | None, known: Words) -> tuple:
    """The values of ``FIELDS`` for one text; ``is_prose`` is None where there is nothing but white space."""
    if text is None or not text or text.isspace():
        return (0, None, None, None, None, None, None, None, None, None, None, None, None, None)
    split = text.splitlines()
    lines = [x for x in split if x and not x.isspace()]
    kinds: Counter = Counter()
    sentences, items = [], 0
    for kind, unit in units(split):
        kinds[kind] += len(unit)
        if kind == "prose":
            sentences.append(unit)
        elif kind in ("list", "table"):
            items += 1
    judged = sum(n for kind, n in kinds.items() if kind not in ("head", "mark")) or 1
    prose_share, list_share, table_share = kinds["prose"] / judged, kinds["list"] / judged, kinds["table"] / judged
    pieces = text.split()
    tokens = _tokens(pieces)
    letters, digits, blanks, encoded, dense = signs_of(text)
    signs = len(text) - blanks
    marks = signs - letters - digits
    times = Counter(tokens)
    own, other, judged_words, n_signs, n_words, *common = known.sums(times)
    common_share = max(common, default=0) / max(1, n_words)
    coverage = phrase_coverage(tokens, times) if tokens else 0.0
    token_share = own * SHUFFLES / other if judged_words >= LEAST_JUDGED else None
    strange = token_share is not None and token_share > MOST_TOKENS[0] - MOST_TOKENS[1] / judged_words
    unspaced, encoded = dense > 0.3 * signs, encoded > 0.5 * max(1, letters)
    length = signs / max(1, len(pieces))
    letter_share = 0.0
    if sentences:
        spoken = "".join(sentences)
        spoken_letters, _, spoken_blanks, *_ = signs_of(spoken)
        letter_share = spoken_letters / max(1, len(spoken) - spoken_blanks)
    is_prose = (
        prose_share >= LEAST_PROSE
        and not (prose_share < FRAMED_PROSE and len(sentences) * FRAME <= items)
        and letter_share >= LEAST_LETTERS
        and (unspaced or WORD_LENGTH[0] <= length <= WORD_LENGTH[1])
        and not encoded
        and not strange
        and not (n_words >= LEAST_WORDS and common_share > MOST_COMMON)
        and not (len(tokens) >= LEAST_WORDS and coverage > MOST_REPEATED)
    )
    return (
        n_words, n_signs / n_words if n_words else None, marks / signs, letters / signs, sum(map(_ends, lines)) / len(lines),
        common_share, _repeated(lines), _repeated([p for p in _BLANK_LINES.split(text) if p.strip()] if len(lines) < len(split) else [text]), coverage,
        prose_share, list_share, table_share, token_share, is_prose,
    )


def text_statistics(df: DataFrame, text: str, keep: list[str], common_words: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Columns ``keep`` and the ``FIELDS`` of ``text``, one row for each row.

    Shares are of the document's characters without white space, its lines or paragraphs; ``common_word_share`` is the largest over the
    languages of ``common_words`` (``lang``, ``word``; a fixed table of small words, of which at most 100,000 are
    allowed). Null, empty and blank texts have no words, and null for all else, ``is_prose`` too. Texts of any length
    are taken whole. ``token_share`` is null for texts of fewer than ``LEAST_JUDGED`` words in scripts that the vocabulary in
    ``folder`` knows; such texts are judged by the other rules. Repeated rows each get a result; an empty table gives an empty table; other columns are not read.
    """
    found = common_words.filter("word IS NOT NULL").select("lang", "word").distinct().limit(100_001).collect()
    if len(found) > 100_000:
        raise ValueError("common_words is meant for small words: more than 100,000 are given")
    languages = sorted({r[0] or "" for r in found})
    common: dict[str, int] = {}
    for lang, word in found:
        common[word.lower()] = common.get(word.lower(), 0) | 1 << languages.index(lang or "")
    given = df.select(*keep, df[text].alias("__text"))
    schema = T.StructType([*given.schema.fields[:-1], *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in FIELDS.items())).fields])
    types = [{"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[v] for v in FIELDS.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words_of(folder, tuple(sorted(common.items())))
        for batch in batches:
            made = [statistics(t, known) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = list(zip(*made)) if made else [()] * len(types)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, t) for c, t in zip(columns, types)]], [*keep, *FIELDS])

    return given.mapInArrow(run, schema)
