"""Byte-level BPE encoding and decoding (operator 1) by recursive DuckDB queries in every task.

A task's distinct words (matches of the splitting pattern) become rows (word, position, token, next
token), one a byte.  The recursive query joins them with the merge table, contracts each word's
leftmost pair of least rank, and goes on until no word has a pair left.  Words of over ``LONG``
bytes are first cut where no token of the vocabulary could cross; their rows are kept by key, so that
a word of many rounds holds each position once.  Decoding aggregates the tokens' bytes in the order
of their positions.

Spark deals the documents; a task holds one slice of texts and a bounded memory of pieces.
Defined cases: null texts are empty, and empty texts have no tokens; repeated rows and rows sharing
an id are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Collection, Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtaint.llm.codes import cut, numbered_pieces, places, sums_of  # noqa: F401
from tabtaint.llm.common import join_id, ready, split_id

LONG = 64
#: Pieces of each of the two generations that a task remembers; pieces and bytes of words encoded at a time.
MEMORY = 250_000
BATCH_PIECES, BATCH_BYTES = 1 << 14, 1 << 20
SLICE_CHARS = 4 << 20

#: One contraction a word and round: the least of rank * 256 + position names the pair.
SHORT = """
WITH RECURSIVE token(word, pos, id, following, done) AS (
  SELECT word, pos, id, following, false FROM first_tokens
UNION ALL (
  WITH pair AS (
    SELECT t.word, t.pos, t.id, t.following, m.id AS merged
    FROM token t LEFT JOIN merges m ON m.a = t.id AND m.b = t.following WHERE NOT t.done),
  best AS (SELECT word, min(CAST(merged AS BIGINT) * 256 + pos) AS k FROM pair GROUP BY word),
  cut AS (
    SELECT b.word, CAST(b.k // 256 AS INTEGER) AS made, CAST(b.k % 256 AS INTEGER) AS place, p.following AS beyond
    FROM best b LEFT JOIN pair p ON p.word = b.word AND p.pos = b.k % 256 + 1)
  SELECT p.word, p.pos - CASE WHEN p.pos > place THEN 1 ELSE 0 END, CASE WHEN p.pos = place THEN made ELSE id END,
         CASE WHEN p.pos = place THEN beyond WHEN p.pos = place - 1 THEN made ELSE following END, made IS NULL
  FROM pair p JOIN cut c ON p.word = c.word WHERE place IS NULL OR p.pos <> place + 1))
SELECT word, pos, id FROM token WHERE done
"""
#: The same for words of any length; a position is overwritten, and a shorter word's last ones are stale.
ANY = """
WITH RECURSIVE token(word, pos, id, round) USING KEY (word, pos) AS (
    SELECT word, pos, id, 0 FROM first_tokens
  UNION
    SELECT word, row_number() OVER (PARTITION BY word ORDER BY pos) - 1, CASE WHEN merge THEN least_id ELSE id END, round + 1
    FROM (
      SELECT *, coalesce(lag(merge) OVER (PARTITION BY word ORDER BY pos), false) AS gone
      FROM (
        SELECT *, coalesce(pos = min(pos) FILTER (merged = least_id) OVER (PARTITION BY word), false) AS merge
        FROM (
          SELECT p.*, m.id AS merged, min(m.id) OVER (PARTITION BY word) AS least_id
          FROM (SELECT *, lead(id) OVER (PARTITION BY word ORDER BY pos) AS other FROM token) p
          LEFT JOIN merges m ON m.a = p.id AND m.b = p.other))
      WHERE least_id IS NOT NULL)
    WHERE NOT gone
)
SELECT word, pos, id FROM token JOIN (SELECT word, max(round) AS round FROM token GROUP BY word) USING (word, round)
"""
#: Aggregation of the tokens in the order of their positions.  One thread reads the sorted rows, which
#: costs a tenth of sorting within each word; :meth:`Codec._encode` checks that the words come back.
DECODE = """
SELECT count(*) AS n, string_agg(id, ' ') AS ids, CAST(unhex(string_agg(bytes, '')) AS BLOB) AS bytes
FROM (SELECT word, id, bytes FROM ({tokens}) JOIN vocabulary USING (id) ORDER BY word, pos)
GROUP BY word ORDER BY word
"""

#: What a piece of text becomes: number of tokens, their ids as text, the decoded bytes.
Coded = tuple[int, str, bytes]
#: The same in Arrow, where a piece takes a few bytes beside its contents; a blank follows each id.
CODED = pa.schema([("piece", pa.large_string()), ("n", pa.int64()), ("ids", pa.large_string()), ("decoded", pa.large_binary())])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder of one rank file, with a DuckDB connection of its own."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.words = regex.compile(pattern)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t))
                 if t[:k] in self.ranks and t[k:] in self.ranks]
        self.crossed = {t[k:k + 2] for t in self.ranks for k in range(len(t) - 1)}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        a, b, r = zip(*pairs, strict=True)
        self._table("merges", a=pa.array(a, pa.int32()), b=pa.array(b, pa.int32()), id=pa.array(r, pa.int32()))
        self._table("vocabulary", id=pa.array(self.ranks.values(), pa.int32()),
                    bytes=pa.array([t.hex() for t in self.ranks]))
        self.new, self.old = CODED.empty_table(), CODED.empty_table()

    def _table(self, table: str, **columns: pa.Array) -> None:
        data = pa.table(columns)
        self.con.register("incoming", data)
        self.con.execute(f"CREATE OR REPLACE TABLE {table} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def _encode(self, words: list[bytes], query: str) -> list[Coded]:
        """Each (non-empty) word's tokens."""
        if not words:
            return []
        size = np.array([len(w) for w in words])
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(size)
        last = np.zeros(len(ids), bool)
        last[ends - 1] = True
        self._table("first_tokens", word=pa.array(np.repeat(np.arange(len(words), dtype=np.int32), size)),
                    pos=pa.array(np.arange(len(ids)) - np.repeat(ends - size, size)), id=pa.array(ids),
                    following=pa.array(np.append(ids[1:], np.int32(0)), mask=last))
        got = self.con.execute(DECODE.format(tokens=query)).fetchnumpy()
        decoded = [bytes(b) for b in got["bytes"].tolist()]
        if decoded != words:
            raise ValueError("a word's tokens were not aggregated in order")
        return list(zip(got["n"].tolist(), got["ids"].tolist(), decoded, strict=True))

    def _parts(self, word: bytes) -> list[bytes]:
        """A long word cut between bytes that no token holds next to each other."""
        at = [k for k in range(1, len(word)) if word[k - 1:k + 1] not in self.crossed]
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)], strict=True)]

    def _words(self, words: set[str]) -> dict[str, Coded]:
        out: dict[str, Coded] = {}
        batch: list[tuple[str, bytes]] = []
        room = BATCH_BYTES
        for w in words:
            data = w.encode("utf-8", "replace")
            if len(data) > LONG:
                out[w] = _joined(self._encode(self._parts(data), ANY))
                continue
            batch.append((w, data))
            room -= len(data)
            if room < 0:
                out.update(self._short(batch))
                batch, room = [], BATCH_BYTES
        out.update(self._short(batch))
        return out

    def _short(self, batch: list[tuple[str, bytes]]) -> Iterator[tuple[str, Coded]]:
        return zip([w for w, _ in batch], self._encode([b for _, b in batch], SHORT), strict=True)

    def _fresh(self, pieces: pa.Array) -> pa.Table:
        """Pieces that aren't remembered, some at a time: only their texts and tokens are Python objects."""
        parts = [CODED.empty_table()]
        for k in range(0, len(pieces), BATCH_PIECES):
            some = pieces[k:k + BATCH_PIECES].to_pylist()
            split = [self.words.findall(p) for p in some]
            known = self._words({w for ws in split for w in ws})
            n, ids, decoded = zip(*(known[ws[0]] if len(ws) == 1 else _joined([known[w] for w in ws]) for ws in split), strict=True)
            parts.append(pa.table([some, n, [x and x + " " for x in ids], decoded], schema=CODED))
        return pa.concat_tables(parts)

    def coded(self, distinct: pa.Array) -> pa.Table:
        """A row for each of some distinct, non-empty pieces; those seen lately are remembered."""
        known = pa.concat_tables([self.new, self.old]).combine_chunks()
        at = pc.index_in(distinct, value_set=known["piece"].combine_chunks())
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(at < 0)
        at[missing] = len(known) + np.arange(len(missing))
        out = pa.concat_tables([known, self._fresh(distinct.take(pa.array(missing)))]).take(pa.array(at)).combine_chunks()
        added = out.filter(pa.array(at >= len(self.new)))
        if len(self.new) + len(added) > MEMORY:
            self.old, self.new, added = self.new, CODED.empty_table(), out
        self.new = pa.concat_tables([self.new, added[:MEMORY - len(self.new)]]).combine_chunks()
        return out

    def code(self, pieces: Collection[str]) -> dict[str, Coded]:
        """:meth:`coded` by piece, as Python objects."""
        rows = self.coded(pa.array(list(pieces), pa.large_string())).to_pylist()
        return {r["piece"]: (r["n"], r["ids"][:-1], r["decoded"]) for r in rows}


def _joined(parts: list[Coded]) -> Coded:
    return sum(n for n, _, _ in parts), " ".join([ids for _, ids, _ in parts]), b"".join([b for _, _, b in parts])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The task's codec; a worker that goes on to other tasks keeps it."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    size = batch["text"].map(lambda t: len(t or "") + 64).cumsum()
    for _, part in batch.groupby(size // SLICE_CHARS, sort=False):
        yield part


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", with_ids: bool = False,
           with_decoded: bool | None = None) -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``
    and ``decoded`` (the decoded bytes; with the ids unless told otherwise)."""
    ready(docs)
    with_decoded = with_ids if with_decoded is None else with_decoded

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for batch in batches:
            for part in _slices(batch):
                at, distinct, size = numbered_pieces(pa.array([t or "" for t in part["text"]], pa.large_string()), runs=True)
                coded = c.coded(distinct)
                out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
                out["n_tokens"] = sums_of(coded["n"].to_numpy()[at], size).tolist()
                for name in ("ids", "decoded"):   # all documents' ids as text, then their bytes: each document's are a slice
                    start, data = places(coded[name].combine_chunks().take(pa.array(at)))
                    ends = np.cumsum(size)
                    first, end = start[ends - size], start[ends]
                    if name == "ids":
                        end = np.maximum(first, end - 1)
                    view = memoryview(data)
                    for a, b in zip(first.tolist(), end.tolist(), strict=True):
                        out[f"{name}_sha256"].append(hashlib.sha256(view[a:b]).hexdigest())
                        if name == "ids" and with_ids:
                            out["ids"].append(np.array(bytes(view[a:b]).split(), np.int32))
                        if name == "decoded" and with_decoded:
                            out["decoded"].append(bytes(view[a:b]))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "no_id": part["no_id"].to_numpy(),
                                    **{k: v for k, v in out.items() if v or k[-6:] == "sha256" or k == "n_tokens"}})
                del coded, start, data, view
        pa.default_memory_pool().release_unused()   # the worker waits for other tasks beside the JVM

    schema = "doc_id bigint, no_id boolean, n_tokens bigint, ids_sha256 string, decoded_sha256 string" \
        + ", ids array<int>" * with_ids + ", decoded binary" * with_decoded
    return join_id(docs.select(*split_id(), F.col(f"`{text}`").alias("text")).mapInPandas(run, schema))
