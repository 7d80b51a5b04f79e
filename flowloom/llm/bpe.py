"""Problem 6: byte-level BPE ids of every text, by recursive queries in an embedded DuckDB per partition.

A text is cut into words by the tokenizer's pattern; each distinct word of a partition becomes rows (word, position,
token), first one byte each. A recursive query joins neighbouring tokens with the merge table, contracts
each word's leftmost pair of minimum rank, and repeats until no word has a pair left. An ordered aggregation then puts the
tokens of each word in order. The tokenizer's file is read from `path` by the driver and travels with the task; nothing of it is stored here.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.batches import slices

TOKENIZER = os.environ.get("FLOWLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
# Fixed value: the pattern that cuts words for byte-level BPE of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOOP = """
WITH RECURSIVE state(w, pos, tok, step) AS (
  SELECT w, pos, tok, 0 FROM bytes_of_words
  UNION ALL
  (WITH pairs AS (SELECT a.w, a.pos, m.rank, m.id, m.l = m.r AS twin FROM state a JOIN state b ON b.w = a.w AND b.pos = a.pos + 1 JOIN merges m ON m.l = a.tok AND m.r = b.tok),
   best AS (SELECT w, min(rank) AS rank FROM pairs GROUP BY w),
   hits AS (SELECT p.w, p.pos, p.id, p.twin FROM pairs p JOIN best b ON b.w = p.w AND b.rank = p.rank),
   {taken}
   marked AS (SELECT s.w, s.pos, coalesce(t.id, s.tok) AS tok, s.step, e.pos IS NOT NULL AS ends FROM state s JOIN best b ON b.w = s.w LEFT JOIN taken t ON t.w = s.w AND t.pos = s.pos LEFT JOIN taken e ON e.w = s.w AND e.pos = s.pos - 1)
   SELECT w, CAST(row_number() OVER (PARTITION BY w ORDER BY pos) AS INTEGER), tok, step + 1 FROM marked WHERE NOT ends)
)
SELECT s.w, list(s.tok ORDER BY s.pos) AS ids FROM state s JOIN (SELECT w, max(step) AS step FROM state GROUP BY w) USING (w, step) GROUP BY s.w ORDER BY s.w
"""
# One place a round: the leftmost of the pair of minimum rank.
CONTRACT_ONE = _LOOP.format(taken="taken AS (SELECT w, min(pos) AS pos, first(id) AS id FROM hits GROUP BY w),")
# All places of the pair of minimum rank a round, from the left; of a run of equal tokens, whose pairs overlap, every other one.
CONTRACT = _LOOP.format(taken="""runs AS (SELECT w, pos, id, pos - row_number() OVER (PARTITION BY w ORDER BY pos) AS run FROM hits WHERE twin),
   taken AS (SELECT w, pos, id FROM hits WHERE NOT twin UNION ALL SELECT w, pos, id FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY pos) AS nth FROM runs) WHERE nth % 2 = 1),""")


def byte_symbols() -> dict[str, int]:
    """The vocabulary's printable symbol of each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """The id of each byte, the merge table (l, r, rank, id), and whether every merge ranks above all makers of its two parts.

    If so, contracting a pair makes no pair of lower rank, so all places of a word's minimum pair may be contracted in one round.
    """

    of_byte: np.ndarray
    merges: pa.Table
    ordered: bool


def vocabulary(path: str) -> Vocabulary:
    """Read from a tokenizer's JSON file; a file that is not there, or not of this kind, raises."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    of_byte = np.zeros(256, np.int32)
    for symbol, b in byte_symbols().items():
        of_byte[b] = ids[symbol]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    columns = {"l": [ids[a] for a, _ in pairs], "r": [ids[b] for _, b in pairs], "rank": range(len(pairs)), "id": [ids[a + b] for a, b in pairs]}
    last_maker: dict[int, int] = dict(zip(columns["id"], columns["rank"], strict=True))
    ordered = all(last_maker.get(x, -1) < n for n, x, y in zip(columns["rank"], columns["l"], columns["r"], strict=True) for x in (x, y))
    return Vocabulary(of_byte, pa.table({k: pa.array(v, pa.int32()) for k, v in columns.items()}), ordered)


class Encoder:
    """Encodes batches of texts in one DuckDB connection; words seen before are not encoded again."""

    def __init__(self, vocabulary: Vocabulary, kept_words: int = 200_000):
        import duckdb
        import regex

        self.cut = regex.compile(PATTERN).findall
        self.of_byte, self.kept_words = vocabulary.of_byte, kept_words
        self.query = CONTRACT if vocabulary.ordered else CONTRACT_ONE
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        self.con.register("m", vocabulary.merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.tokens, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _contract(self, words: list[str]) -> None:
        """Adds the token ids of new words, in their order."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int32, len(raw))
        word = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows = {"w": word, "pos": np.arange(len(word), dtype=np.int64) - first, "tok": self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]}
        self.con.register("rows", pa.table({k: pa.array(v, pa.int32()) for k, v in rows.items()}))
        self.con.execute("CREATE OR REPLACE TEMP TABLE bytes_of_words AS SELECT * FROM rows")
        got = self.con.sql(self.query).to_arrow_table()["ids"].combine_chunks()
        self.con.unregister("rows")
        start = self.ends[-1] if len(self.ends) else 0
        self.ends = np.concatenate([self.ends, start + got.offsets.to_numpy()[1:].astype(np.int64) - got.offsets[0].as_py()])
        self.tokens = np.concatenate([self.tokens, got.flatten().to_numpy()])

    def encode(self, texts: list[str | None]) -> pa.Array:
        """A list of ids for each text; empty for null and empty texts."""
        if len(self.index) > self.kept_words:
            self.forget()
        words = [self.cut(t) if t else [] for t in texts]
        flat = [w for ws in words for w in ws]
        fresh = list(dict.fromkeys(w for w in flat if w not in self.index))
        if fresh:
            for w in fresh:
                self.index[w] = len(self.index)
            self._contract(fresh)
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        begin = (self.ends[at - 1] if len(at) else at) * (at > 0)
        sizes = self.ends[at] - begin if len(at) else at
        upto = np.concatenate([[0], np.cumsum(sizes)])
        # Each word's tokens are copied to their place: an index that restarts at every word's beginning.
        ids = self.tokens[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], sizes)]
        ends = upto[np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def _run(vocabulary: Vocabulary, lengths: bool):
    def run(batches):
        encoder = None
        for b in batches:
            if encoder is None and b.num_rows:
                encoder = Encoder(vocabulary)
            for at, n in slices(pc.fill_null(pc.binary_length(b.column(0)), 0).to_pylist()):
                part = b.slice(at, n)
                ids = encoder.encode(part.column(0).to_pylist())
                kept = [part.column(i) for i in range(1, part.num_columns)]
                last = pc.list_value_length(ids).cast(pa.int64()) if lengths else ids
                yield pa.RecordBatch.from_arrays([*kept, last], names=[*part.schema.names[1:], "n_tokens" if lengths else "ids"])

    return run


def encode_documents(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids): the token ids of each text as stored, without special tokens, whose strings are ordinary text.

    Null and empty texts give an empty list, repeated documents a row each. Only doc_id and text are read. An empty table gives no rows.
    """
    texts = documents.select(F.col("text").cast("string"), F.col("doc_id").cast("bigint"))
    return texts.mapInArrow(_run(vocabulary(path), lengths=False), "doc_id bigint, ids array<int>")


def token_lengths(texts: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """The columns of `texts` but its first, the text, followed by n_tokens, the number of the text's token ids (0 for null and empty)."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[1:])
    return texts.mapInArrow(_run(vocabulary(path), lengths=True), f"{kept}, n_tokens bigint")
