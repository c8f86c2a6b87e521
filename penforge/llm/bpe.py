"""Byte-level BPE through DuckDB recursive queries, one connection for each Python worker.

A text is cut into words by the tokenizer's pattern. Words not met before go, together, into one recursive query:
each round lays a word's tokens out as rows by position, joins neighbouring pairs to the merge table, and contracts
the leftmost pair of least rank, until no pair is left. Ids are decoded by joining token rows to the vocabulary and
aggregating them in order. A bounded store keeps pieces of text met before; it changes no result.

A long word is first cut where no token of the vocabulary could ever lie across, and what is left long is contracted
at all places of its least pair in one round, up to the first one after which another pair would come before: the same
merges in the same order. So a word of a megabyte takes few rounds. A huge one goes through the same rounds slice by
slice, each slice joined to the merge table, until it is small enough for the recursive query: a query never holds more
than HUGE tokens, whatever the word. Ids are decoded in slices, too.

Defined cases: a null text counts as empty (no ids; the hashes of nothing); repeated rows, null doc_ids and further
columns give a row each; long texts are handled whole, in batches bounded by characters, not rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Pieces, read_table, released, whole_text

#: Bytes of text, or ids, that are worked on at once; a longer text makes a batch of its own.
BATCH_BYTES, BATCH_IDS = 1_000_000, 300_000
#: Words, and chunks of text, that are remembered, and their ids.
REMEMBERED = 150_000, 2_000_000
#: Bytes from which a word is long: it is cut apart, and what stays long is contracted at many places a round.
LONG = 64
#: Tokens from which a word is huge, and how many of them a query then gets at once.
HUGE, SLICE = 300_000, 200_000
#: Words, and their bytes, in one recursive query; a longer word has one of its own.
QUERY_WORDS, QUERY_BYTES = 10_000, 400_000

#: merges: pair, merged. The least id that a pair makes is its rank.
ENCODE_SQL = """
WITH RECURSIVE state(word, round, ids) AS (
  SELECT word, 0, ids FROM start
  UNION ALL
  SELECT state.word, round + 1, ids[:best.pos - 1] || [best.merged] || ids[best.pos + 2:]
  FROM state JOIN (
    SELECT word, min(merges.merged) AS merged, arg_min(pos, merges.merged::BIGINT * 4294967296 + pos) AS pos
    FROM (SELECT word, unnest(range(1, len(ids))) AS pos, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b FROM state) AS pairs
    JOIN merges ON merges.pair = pairs.a::BIGINT * 4294967296 + pairs.b
    GROUP BY word) AS best USING (word)
)
SELECT word, arg_max(ids, round) AS ids FROM state GROUP BY word ORDER BY word
"""
#: For long words; of each only the last round is kept. Of a run of overlapping places every other one counts; a place whose merge makes a lesser pair with
#: what then stands beside it is the last one of its round.
LONG_SQL = """
WITH RECURSIVE state(word, ids) USING KEY (word) AS (
  SELECT word, ids FROM start
  UNION
  (WITH tokens AS (SELECT word, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS pos FROM state),
    pairs AS (SELECT word, pos, lag(id) OVER w AS w, id AS a, lead(id) OVER w AS b, lead(id, 2) OVER w AS z FROM tokens WINDOW w AS (PARTITION BY word ORDER BY pos)),
    found AS (SELECT pairs.*, merged, min(merged) OVER (PARTITION BY word) AS least FROM pairs JOIN merges ON merges.pair = a::BIGINT * 4294967296 + b),
    least AS (SELECT *, pos - row_number() OVER (PARTITION BY word ORDER BY pos) AS run FROM found WHERE merged = least),
    apart AS (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY pos) AS nth FROM least),
    places AS (SELECT *, CASE WHEN lag(pos) OVER (PARTITION BY word ORDER BY pos) = pos - 2 THEN merged ELSE w END AS beside FROM apart WHERE nth % 2 = 1),
    stops AS (
      SELECT p.word, p.pos, p.merged, sum(CASE WHEN least(l.merged, r.merged) < p.merged THEN 1 ELSE 0 END) OVER (PARTITION BY p.word ORDER BY p.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n
      FROM places AS p LEFT JOIN merges AS l ON l.pair = p.beside::BIGINT * 4294967296 + p.merged LEFT JOIN merges AS r ON r.pair = p.merged::BIGINT * 4294967296 + p.z),
    now AS (SELECT word, pos, merged FROM stops WHERE coalesce(n, 0) = 0)
  SELECT t.word, list(coalesce(here.merged, t.id) ORDER BY t.pos)
  FROM tokens AS t LEFT JOIN now AS here ON here.word = t.word AND here.pos = t.pos LEFT JOIN now AS gone ON gone.word = t.word AND gone.pos = t.pos - 1
  WHERE gone.pos IS NULL AND t.word IN (SELECT word FROM now) GROUP BY t.word)
)
SELECT word, ids FROM state ORDER BY word
"""
DECODE_SQL = """
SELECT doc, list(piece ORDER BY pos) AS pieces FROM tokens JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc
"""


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.by_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.names = pa.array([str(i) for i in range(max(self.ranks.values()) + 1)])
        self.words, self.chunks = Pieces(*REMEMBERED), Pieces(*REMEMBERED)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(rank)
        self._table("merges", pa.table({"pair": pa.array(pairs, pa.int64()), "merged": pa.array(merged, pa.int32())}))
        self._table("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int64()), "piece": pa.array(self.ranks, pa.binary())}))
        #: which two bytes are a token, and which three stand in one
        self.two = np.zeros(1 << 16, bool)
        self.two[[t[0] << 8 | t[1] for t in self.ranks if len(t) == 2]] = True
        self.three = np.unique(np.array([t[i] << 16 | t[i + 1] << 8 | t[i + 2] for t in self.ranks for i in range(len(t) - 2)], np.int32))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given").fetchall()
        self.db.unregister("given")

    def _query(self, name: str, rows: pa.Table, sql: str) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _contract(self, words: list[bytes], sql: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has)."""
        ends = np.cumsum([0, *map(len, words)], dtype=np.int32)
        flat = self.by_byte[np.frombuffer(b"".join(words), np.uint8)]
        if len(words) == 1 and len(flat) > HUGE:
            flat = self._shortened(flat)
            if len(flat) > HUGE:  # no pair is left
                return flat, np.array([len(flat)])
            ends = np.array([0, len(flat)], np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        got = self._query("start", pa.table({"word": pa.array(range(len(words)), pa.int32()), "ids": ids}), sql)["ids"].combine_chunks()
        return got.values.to_numpy(), np.diff(got.offsets.to_numpy())

    def _shortened(self, ids: np.ndarray) -> np.ndarray:
        """The tokens of a huge word after as many rounds as it takes until it isn't huge, or has no pair left."""
        while len(ids) > HUGE:
            least = min((m for a in range(0, len(ids) - 1, SLICE) if (m := self._least(ids[a : a + SLICE + 1])) is not None), default=None)
            if least is None:
                break
            ids = self._round(ids, least)
        return ids

    def _least(self, ids: np.ndarray) -> int | None:
        pairs = ids[:-1].astype(np.int64) << 32 | ids[1:]
        return self._query("pairs", pa.table({"pair": pairs}), "SELECT min(merged) AS least FROM pairs JOIN merges USING (pair)")["least"][0].as_py()

    def _round(self, ids: np.ndarray, least: int) -> np.ndarray:
        """ids with `least` at the places of its pairs, as in a round of LONG_SQL: every other one of a run of overlapping
        places, up to the first that makes a lesser pair with what stands beside it."""
        out, kept = ids.copy(), np.ones(len(ids), bool)
        last, nth, taken = -9, 0, -9  # the last place, its number in its run, the last place that was taken
        for a in range(0, len(ids) - 1, SLICE):
            part = ids[a : a + SLICE + 1]
            rows = pa.table({"pair": part[:-1].astype(np.int64) << 32 | part[1:], "pos": np.arange(a, a + len(part) - 1)})
            pos = self._query("pairs", rows, f"SELECT pos FROM pairs JOIN merges USING (pair) WHERE merged = {least} ORDER BY pos")["pos"].to_numpy()
            if not len(pos):
                continue
            begins = np.diff(pos, prepend=last) != 1
            start = np.maximum.accumulate(np.where(begins, np.arange(len(pos)), -1))
            number = np.where(start < 0, np.arange(len(pos)) + nth + 1, np.arange(len(pos)) - start)
            last, nth = int(pos[-1]), int(number[-1])
            pos = pos[number % 2 == 0]
            if not len(pos):
                continue
            beside = np.where(np.diff(pos, prepend=taken) == 2, least, np.where(pos > 0, ids[pos - 1], -1)).astype(np.int64)
            after = np.where(pos + 2 < len(ids), ids[np.minimum(pos + 2, len(ids) - 1)], -1).astype(np.int64)
            both = pa.table({"pair": np.concatenate([beside << 32 | least, np.int64(least) << 32 | (after & 0xFFFFFFFF)]), "pos": np.concatenate([pos, pos])})
            stop = self._query("pairs", both, f"SELECT min(pos) AS stop FROM pairs JOIN merges USING (pair) WHERE merged < {least}")["stop"][0].as_py()
            pos = pos if stop is None else pos[pos <= stop]
            out[pos], kept[pos + 1], taken = least, False, int(pos[-1])
            if stop is not None:
                break
        return out[kept]

    def _apart(self, word: bytes) -> list[bytes]:
        """A word cut where no token can lie across: one that did would be those two bytes, or hold a third beside them."""
        x = np.frombuffer(word, np.uint8).astype(np.int32)
        inside = np.isin(x[:-2] << 16 | x[1:-1] << 8 | x[2:], self.three)
        crossed = self.two[x[:-1] << 8 | x[1:]]
        crossed[:-1] |= inside  # with the byte after them
        crossed[1:] |= inside  # with the byte before them
        cuts = [0, *(np.flatnonzero(~crossed) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _learn_words(self, words: list[bytes]) -> None:
        """The ids of words; every one goes through the recursive query unless it is one token."""
        whole = [w for w in words if w in self.ranks]
        self.words.remember(whole, np.array([self.ranks[w] for w in whole], np.int32), np.ones(len(whole), np.int64))
        rest = [w for w in words if w not in self.ranks]
        self._query_words([w for w in rest if len(w) < LONG], ENCODE_SQL)
        if long := {w: self._apart(w) for w in rest if len(w) >= LONG}:
            new = [p for p in dict.fromkeys(p for parts in long.values() for p in parts) if p not in self.words.known]
            self._learn_words([p for p in new if len(p) < LONG])
            self._query_words([p for p in new if len(p) >= LONG], LONG_SQL)
            for word, parts in long.items():
                if len(parts) > 1:
                    ids, sizes = self.words.take(self.words.numbers(parts))
                    self.words.remember([word], ids, np.array([sizes.sum()]))

    def _query_words(self, words: list[bytes], sql: str) -> None:
        words = sorted(words, key=len)
        for some in slices([max(len(w), QUERY_BYTES // QUERY_WORDS) for w in words], QUERY_BYTES):
            self.words.remember(words[some], *self._contract(words[some], sql))

    def _learn(self, chunks: list[bytes]) -> None:
        """The ids of chunks of text by their words."""
        cut = [[w.encode() for w in self.pattern.findall(c.decode())] for c in chunks]
        known = self.words.known
        self._learn_words([w for w in dict.fromkeys(w for words in cut for w in words) if w not in known])
        ids, sizes = self.words.take(self.words.numbers([w for words in cut for w in words]))
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, cut)])]
        self.chunks.remember(chunks, ids, np.diff(upto))

    def encode(self, texts: pa.StringArray) -> pa.ListArray:
        """The ids of each text; texts holds no null."""
        for store in (self.words, self.chunks):
            store.forget()
        chunks, ends = chunked(texts)
        coded = chunks.dictionary_encode()
        some = coded.dictionary.to_pylist()
        self._learn([c for c in some if c not in self.chunks.known])
        ids, sizes = self.chunks.take(self.chunks.numbers(some)[coded.indices.to_numpy()])
        upto = np.concatenate([[0], np.cumsum(sizes)])[ends]
        return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids))

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        """The bytes of each list of ids."""
        out, ends = [b""] * len(ids), ids.offsets.to_numpy().astype(np.int64)
        lens = np.diff(ends)
        if len(ids) == 1 and lens[0] > BATCH_IDS:
            cuts = pa.array([*range(ends[0], ends[1], BATCH_IDS), ends[1]], pa.int32())
            some = pa.ListArray.from_arrays(cuts, ids.values)
            return [b"".join(self.decode(some[i : i + 1])[0] for i in range(len(some)))]
        if not lens.sum():
            return out
        rows = pa.table({"doc": np.repeat(np.arange(len(ids)), lens), "pos": np.arange(ends[-1] - ends[0]), "id": ids.flatten().cast(pa.int64())})
        got = self._query("tokens", rows, DECODE_SQL)
        docs, pieces = got["doc"].to_pylist(), got["pieces"].combine_chunks()
        at, flat = pieces.offsets.to_numpy(), pieces.values
        starts = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
        data = memoryview(flat.buffers()[2])
        for doc, a, b in zip(docs, at[:-1], at[1:]):
            out[doc] = bytes(data[starts[a] : starts[b]])
        return out

    def hashes(self, ids: pa.ListArray) -> list[str]:
        """SHA-256 of the decimal ids of each list, joined by commas."""
        names = pa.ListArray.from_arrays(ids.offsets, self.names.take(ids.values))
        return [hashlib.sha256(x).hexdigest() for x in pc.binary_join(names, ",").cast(pa.binary()).to_pylist()]


def chunked(texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """(chunks, before which of them each text ends): texts are cut before a space or line feed that follows something
    else than white space, and after a line feed that stands alone; there a word always ends for a tokenizer's pattern."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    x = np.concatenate([np.full(3, 32, np.uint8), data, np.full(1, 32, np.uint8)])  # white space around
    before, second, third = x[2:-2], x[1:-3], x[:-4]
    # letters of two bytes are no white space, nor are those of three after E0 or from E4 on, nor those of four
    wide = (before >= 0x80) & (((second >= 0xC3) & (second < 0xE0)) | ((second >= 0x80) & (second < 0xC0) & ((third == 0xE0) | (third >= 0xE4) | ((third >= 0x80) & (third < 0xC0)))))
    solid = ((before > 32) & (before < 127)) | wide
    cut = solid & ((data == 32) | (data == 10))
    after = np.flatnonzero(cut & (data == 10)) + 1
    after = after[(after < len(data)) & (x[after + 3] > 32) & (x[after + 3] < 127)]
    cut[after] = True
    inner = np.zeros(len(data) + 1, bool)
    inner[: len(data)] = cut
    inner[offsets] = True
    starts = np.flatnonzero(inner)
    chunks = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)])
    return chunks, np.searchsorted(starts, offsets)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def clear_state() -> None:
    codec.cache_clear()


def slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive runs whose sizes sum to at most `most`, or single items."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def _byte_slices(texts: pa.StringArray) -> Iterator[slice]:
    return slices(pc.binary_length(texts).to_pylist(), BATCH_BYTES)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in _byte_slices(batch.column(1)):
                yield pa.record_batch([batch.column(0)[part], own.encode(batch.column(1)[part])], ["doc_id", "ids"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(released(run, __name__), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, bytes (binary) of every list of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = batch.column(1)
            for part in slices(pc.list_value_length(ids).to_pylist(), BATCH_IDS):
                yield pa.record_batch([batch.column(0)[part], ids[part], pa.array(own.decode(ids[part]), pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.mapInArrow(released(run, __name__), "doc_id long, ids array<int>, bytes binary")


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, so with one Python worker a task."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in _byte_slices(batch.column(1)):
                ids = own.encode(batch.column(1)[part])
                sizes = pc.list_value_length(ids)
                read = [hashlib.sha256(x).hexdigest() for some in slices(sizes.to_pylist(), BATCH_IDS) for x in own.decode(ids[some])]
                yield pa.record_batch([batch.column(0)[part], sizes.cast(pa.int64()), pa.array(own.hashes(ids)), pa.array(read)], names)

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(released(run, __name__), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode_decode(read_table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
