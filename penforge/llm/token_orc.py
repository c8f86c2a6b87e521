"""Token ids in ORC: integer run lengths, row indexes, Bloom filters on document ids, one stripe-parallel read.

Texts are dealt by ranges of doc_id and sorted, encoded where they land, and written once; what is shuffled is text,
not ids. Each row keeps its part and its start within the part, so the starts need only a running sum over parts. A
lookup of a document prunes by the files' statistics and Bloom filters.

Defined cases: a null text counts as empty and has only the end id; a null doc_id comes first; repeated rows each
have their own place, ordered by text; a text may be one long word; empty input gives no rows; further columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bpe import slices
from .common import Pieces, fresh_path, read_table, released, whole_text

END_ID = 1
#: Bytes of text whose ids are held at once; a longer text makes a batch of its own.
BATCH_BYTES = 4_000_000
#: New words are encoded in joined texts of about so many, where need be with MARK, a word of one id, between them.
JOINED, MARK = 2_000, "\x02"
#: Fixed value: how the vocabulary writes the end of a word.
WORD_END = "</w>"
#: A word of Latin-1 letters, then ASCII marks other than an apostrophe, is two pieces for the tokenizer's pattern.
PIECES = r"\A(?P<letters>[a-zA-ZÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)\z"
#: What is remembered is forgotten between batches once it is more pieces, or more ids.
MOST_PIECES, MOST_IDS = 500_000, 8_000_000
#: The key of the piece that is the end id alone; no word is so.
END = None

#: Ids are packed by their run lengths, which leaves a compressor little to gain.
ORC_OPTIONS = {
    "compression": "none", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}


class Encoder:
    """Ids of texts. What words are made of, runs of letters and of marks, is encoded once and remembered as a piece:
    a range of one array of ids. Texts are put together by taking pieces by number."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.end_id, self.tokenizer = end_id, Tokenizer.from_file(path)
        # For lower-case Latin-1 letters the normalizer and the pattern change nothing, so they are left out; the bytes
        # that stand for a letter beyond ASCII are put in beforehand.
        self.light = Tokenizer(self.tokenizer.model)
        self.light.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: to_bytes.pre_tokenize_str(c)[0][0] for c in map(chr, (0xDF, *range(0xE0, 0xF7), *range(0xF8, 0x100)))}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.pieces = Pieces(MOST_PIECES, MOST_IDS)

    def _learn_letters(self, words: list[str]) -> None:
        """Lower-case runs of letters; each is one word for the model, whose last id is known by its ending."""
        if not words:
            return
        found = []
        for at in range(0, len(words), JOINED):
            joined = " ".join(words[at : at + JOINED])
            for c in set(joined) & self.as_bytes.keys():
                joined = joined.replace(c, self.as_bytes[c])
            (coded,) = self.light.encode_batch_fast([joined], add_special_tokens=False)
            found.append(np.array(coded.ids, "<i4"))
        ids = np.concatenate(found)
        last = np.flatnonzero(self.ends_word[ids])
        assert len(last) == len(words), "a run of letters isn't one word"
        self.pieces.remember(words, ids, np.diff(last, prepend=-1))

    def _learn(self, words: list[str]) -> None:
        """Any words: no token of this vocabulary crosses white space, so they are encoded together and cut at MARK."""
        odd = [w for w in words if MARK in w]
        words = [w for w in words if MARK not in w]
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            ids = np.array(self.tokenizer.encode(f" {MARK} ".join(some), add_special_tokens=False).ids, "<i4")
            cuts = np.flatnonzero(ids == self.mark)
            assert len(cuts) == len(some) - 1, "the mark came out of a word"
            self.pieces.remember(some, np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1)
        for w in odd:
            ids = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<i4")
            self.pieces.remember([w], ids, np.array([len(ids)]))

    def _numbers(self, words: pa.StringArray, learn) -> np.ndarray:
        """The piece of each word; 0 for a null."""
        coded = words.dictionary_encode()
        some = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        learn([w for w in some if w not in self.pieces.known])
        numbers = np.append(self.pieces.numbers(some), 0)
        return numbers[coded.indices.fill_null(len(some)).to_numpy()]

    def encode(self, texts: pa.StringArray) -> pa.ListArray:
        """The ids of each text with the end id; texts holds no null."""
        self.pieces.forget()
        if "" not in self.pieces.known:
            self.pieces.remember(["", END], np.array([self.end_id]), np.array([0, 1]))
        cut = pc.ascii_split_whitespace(texts)
        coded = cut.values.dictionary_encode()
        parts = pc.extract_regex(coded.dictionary, PIECES)
        whole = pc.if_else(parts.is_null(), coded.dictionary, None)
        first = self._numbers(pc.utf8_lower(pc.struct_field(parts, "letters")), self._learn_letters)
        second = self._numbers(pc.coalesce(pc.struct_field(parts, "marks"), whole), self._learn)
        # each word is two pieces, each text ends with a third kind
        place, ends = coded.indices.to_numpy(), cut.offsets.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(texts)), np.diff(ends))
        at = 2 * np.arange(len(place)) + row
        last = 2 * ends[1:] + np.arange(len(texts))
        pieces = np.empty(2 * len(place) + len(texts), np.int64)
        pieces[at], pieces[at + 1], pieces[last] = first[place], second[place], self.pieces.known[END]
        ids, sizes = self.pieces.take(pieces)
        upto = np.cumsum(sizes)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto[last]]).astype(np.int32)), pa.array(ids))


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def clear_state() -> None:
    encoder.cache_clear()


KIND = "doc_id long, ids array<int>, n_tokens int, part int, start_in_part long"
NAMES = [c.split()[0] for c in KIND.split(", ")]


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID) -> None:
    """ORC files under out, with the columns of KIND, in ascending doc_id order over the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, start = encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            for some in slices(pc.binary_length(texts).to_pylist(), BATCH_BYTES):
                ids = own.encode(texts[some])
                ends = ids.offsets.to_numpy().astype(np.int64)
                sizes = np.diff(ends)
                yield pa.record_batch([batch.column(0)[some], ids, pa.array(sizes.astype(np.int32)), pa.array(np.full(len(sizes), part, np.int32)), pa.array(start + ends[:-1])], NAMES)
                start += int(ends[-1])

    dealt = docs.select("doc_id", whole_text().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(released(run, __name__), KIND).write.options(**ORC_OPTIONS).orc(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The columns of KIND; filters on doc_id skip files, stripes and row groups."""
    return spark.read.schema(KIND).orc(path)


def token_index(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends, flat = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
            crcs = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.record_batch([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = tokens.select("doc_id", "part", "start_in_part", "ids").mapInArrow(released(run), "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    # one row for each file, from two narrow columns
    last = tokens.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(last.select("part", before.alias("before")), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    out = fresh_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), out, P.path("word_bpe_49k.json"))
    return token_index(read_tokens(spark, out))
