"""Problem 6: token ids of a whole corpus by a public byte-level BPE tokenizer.

Method: recursive DuckDB queries inside each partition. A text is cut into words by the tokenizer's pattern; the bytes
of the distinct words of a batch become token-position rows. A recursive query joins neighbouring tokens with the
merge table, contracts each word's leftmost pair of the least rank (and the same pair further right, where it doesn't
overlap), puts the tokens together again by an ordered aggregation, and goes on with the words that changed until none
does. Another query with an ordered aggregation decodes ids to text.

No row leaves its partition. The vocabulary, a fixed file, is read once by each Python worker.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from talkgrid.storage import shared_dir

#: Folder of the vocabulary files; on a cluster, one that each executor has.
FOLDER = "/opt/tokenizers"
#: The pattern by which byte-level tokenizers cut a text into words. White space is Unicode's White_Space,
#: written out, as libraries differ in U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Words of which a worker remembers the ids, and bytes of new words that one recursive query takes at once.
REMEMBERED, BYTES_AT_ONCE = 300_000, 1 << 20
#: What a worker's DuckDB may use.
MEMORY = "500MB"

_ENCODE = """
WITH RECURSIVE encoded(w, toks) USING KEY (w) AS (
    SELECT w, toks FROM words
    UNION
    SELECT w, list(tok ORDER BY p) AS toks FROM (
        WITH rows AS (SELECT w, unnest(toks) AS tok, unnest(range(len(toks))) AS p FROM encoded WHERE len(toks) > 1),
             pairs AS (SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY p) AS tok2 FROM rows),
             ranked AS (SELECT a.*, m.rank, m.merged FROM pairs a LEFT JOIN merges m ON a.tok = m.tok AND a.tok2 = m.tok2),
             best AS (SELECT *, min(rank) OVER (PARTITION BY w) AS least FROM ranked),
             hits AS (SELECT *, rank IS NOT DISTINCT FROM least AS hit FROM best WHERE least IS NOT NULL),
             -- of a run of hits side by side (equal tokens) every other one counts, from the left
             runs AS (SELECT *, p - sum(hit::INT) OVER (PARTITION BY w ORDER BY p) AS run FROM hits),
             chosen AS (SELECT *, hit AND (tok <> tok2 OR row_number() OVER (PARTITION BY w, run, hit ORDER BY p) % 2 = 1) AS contract FROM runs),
             kept AS (SELECT *, coalesce(lag(contract) OVER (PARTITION BY w ORDER BY p), false) AS gone FROM chosen)
        SELECT w, p, CASE WHEN contract THEN merged ELSE tok END AS tok FROM kept WHERE NOT gone
    ) GROUP BY w
)
SELECT w, toks FROM encoded ORDER BY w
"""

_DECODE = """
SELECT doc, string_agg(bytes, '' ORDER BY p) AS bytes
FROM (SELECT doc, unnest(ids) AS id, unnest(range(len(ids))) AS p FROM docs) JOIN vocabulary USING (id) GROUP BY doc
"""


def _byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable bytes stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """The vocabulary and a DuckDB connection of one Python worker, with the words encoded so far.

    Only single words of millions of signs need more memory than ``MEMORY``. The rest of their rows then goes to files
    in ``spill``, a folder that is deleted with the connection; without one such a word is an error.
    """

    def __init__(self, path: str, spill: str = ""):
        import duckdb
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges, sign = model["vocab"], model["merges"], _byte_of_sign()
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.first = np.zeros(256, np.int32)
        for s, b in sign.items():
            self.first[b] = vocab[s]
        self.findall = regex.compile(PATTERN).findall
        if spill:
            os.makedirs(spill, exist_ok=True)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": f"{spill}/duckdb-{uuid.uuid4().hex}" if spill else ""})
        table = pa.table({
            "tok": pa.array([vocab[a] for a, _ in merges], pa.int32()), "tok2": pa.array([vocab[b] for _, b in merges], pa.int32()),
            "rank": pa.array(range(len(merges)), pa.int32()), "merged": pa.array([vocab[a + b] for a, b in merges], pa.int32()),
        })
        self.db.register("given", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")
        self.hex = {i: bytes(sign[c] for c in t).hex() for t, i in vocab.items()}
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        """Encode ``words`` and remember them under the next numbers."""
        at = 0
        while at < len(words):
            raw, size = [], 0
            while at < len(words) and (not raw or size < BYTES_AT_ONCE):
                raw.append(words[at].encode())
                size, at = size + len(raw[-1]), at + 1
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int32)
            toks = pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.first[np.frombuffer(b"".join(raw), np.uint8)]))
            self.db.register("words", pa.table({"w": pa.array(np.arange(len(raw), dtype=np.int32)), "toks": toks}))
            done = self.db.sql(_ENCODE).to_arrow_table().column("toks").combine_chunks()
            self.db.unregister("words")
            self.ids = np.concatenate([self.ids, done.flatten().to_numpy(zero_copy_only=False).astype(np.int32)])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(done.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])

    def encode(self, texts: list[str | None], counts_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (none if ``counts_only``), and the number of ids of each text."""
        docs = [self.findall(t) if t else [] for t in texts]
        fresh: set[str] = set()
        for words in docs:
            fresh.update(words)
        fresh.difference_update(self.index)
        if fresh:
            order = sorted(fresh)
            base = len(self.index)
            self.index.update(zip(order, range(base, base + len(order))))
            self.learn(order)
        number = self.index.__getitem__
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        which = np.fromiter((k for words in docs for k in map(number, words)), np.int64, int(sizes.sum()))
        lengths = np.diff(self.offsets)[which] if len(which) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        counts = ends[bounds[1:]] - ends[bounds[:-1]]
        ids = np.zeros(0, np.int32)
        if not counts_only and len(which):
            # position of each id: the start of its word, and how far it is into the word
            ids = self.ids[np.repeat(self.offsets[which] - ends[:-1], lengths) + np.arange(ends[-1])]
        if len(self.index) > REMEMBERED:
            self.forget()
        return ids, counts


@functools.cache
def encoder(path: str, spill: str) -> Encoder:
    return Encoder(path, spill)


def _spill_folder(spark: SparkSession) -> str:
    """The shared folder as a path, if it is mounted as one; else ""."""
    folder = shared_dir(spark)
    return folder.removeprefix("file:").replace("//", "/", 1) if folder.startswith("file:") else folder if folder.startswith("/") else ""


def _encoded(df: DataFrame, text: str, keep: list[str], out: T.StructField, path: str, counts_only: bool) -> DataFrame:
    spill = _spill_folder(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(path, spill)
        for batch in batches:
            ids, counts = worker.encode(batch.column(batch.num_columns - 1).to_pylist(), counts_only)
            if counts_only:
                made = pa.array(counts, pa.int64())
            else:
                made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*keep, out.name])

    given = df.select(*keep, df[text].alias("__text"))
    return given.mapInArrow(run, T.StructType([*given.schema.fields[:-1], out]))


def encode_texts(df: DataFrame, text: str, keep: list[str], out: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """Columns ``keep`` and the token ids of ``text`` as ``out`` (array of int), one row for each row.

    No special tokens are added, and their strings in a text are ordinary text. Null and empty texts give an empty
    list. Repeated rows each get a result; an empty table gives an empty table; other columns are not read. A text of
    any length is encoded whole.
    """
    field = T.StructField(out, T.ArrayType(T.IntegerType(), False), False)
    return _encoded(df, text, keep, field, f"{folder}/{tokenizer}.json", False)


def count_tokens(df: DataFrame, text: str, keep: list[str], out: str = "n_tokens", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """As ``encode_texts``, but the number of token ids (bigint; 0 for null and empty texts)."""
    return _encoded(df, text, keep, T.StructField(out, T.LongType(), False), f"{folder}/{tokenizer}.json", True)


def decode_ids(df: DataFrame, ids: str, keep: list[str], out: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """Columns ``keep`` and the text of the token ids ``ids``: "" for an empty or null list.

    Unknown and null ids are left out; bytes that aren't UTF-8 become U+FFFD.
    """
    path, spill = f"{folder}/{tokenizer}.json", _spill_folder(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(path, spill)
        worker.db.execute("CREATE TABLE IF NOT EXISTS vocabulary(id INTEGER, bytes VARCHAR)")
        if not worker.db.execute("SELECT count(*) FROM vocabulary").fetchall()[0][0]:
            worker.db.register("given", pa.table({"id": pa.array(worker.hex.keys(), pa.int32()), "bytes": pa.array(worker.hex.values(), pa.string())}))
            worker.db.execute("INSERT INTO vocabulary SELECT * FROM given")
            worker.db.unregister("given")
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            worker.db.register("docs", pa.table({"doc": pa.array(range(batch.num_rows), pa.int64()), "ids": lists}))
            known = dict(worker.db.execute(_DECODE).fetchall())
            worker.db.unregister("docs")
            texts = [bytes.fromhex(known.get(k, "")).decode("utf-8", "replace") for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, out])

    given = df.select(*keep, df[ids].alias("__ids"))
    return given.mapInArrow(run, T.StructType([*given.schema.fields[:-1], T.StructField(out, T.StringType(), False)]))
