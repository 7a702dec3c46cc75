"""BPE encoding by a table of distinct words, decoding by a join of ids with pieces.

Texts are split into words at places where the tokenizer itself always splits: ASCII white space, and between letters
of the Latin-1 range and closing punctuation.  A table holds every distinct word of the corpus but the rarest, each encoded
once by the tokenizers library, and is broadcast within a proven size.  A task gives each distinct word of its
texts a number, looks the number up in the table, and joins ids back by position.  Words that are too rare
for the table are encoded by the task, once for all their places in a slice of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, stage
from .words import HEAD_WORDS, chunks, head, word_counts

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = rf"^[{_LATIN}]+[.,;:!?]*$"
_MARKS = ".,;:!?"
_LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))


def split_chunks(found: pa.Array) -> list[pa.Array]:
    """The words of each chunk, place by place: of Latin-1 letters and closing punctuation the word in lower case and the
    punctuation, of any other the whole chunk and nothing."""
    plain = pc.match_substring_regex(found, _WORD)
    word, marks = pc.utf8_lower(pc.utf8_rtrim(found, characters=_MARKS)), pc.utf8_ltrim(found, characters=_LETTERS)
    return [pc.if_else(plain, word, found), pc.if_else(plain, marks, "")]


_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer, once per process; its own truncation and padding are off."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _LOADED[path] = made
    return _LOADED[path]


def pieces(path: str) -> pa.Array:
    """The piece of every id; bounded by the vocabulary."""
    t = tokenizer(path)
    return pa.array([t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))], pa.string())


def encoded_words(counts: DataFrame, path: str) -> DataFrame:
    """(word, n, ids) with one row, and one encoding, for each distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            made = t.encode_batch(batch.column("word").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array([e.ids for e in made], pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return counts.mapInArrow(run, "word string, n long, ids array<int>")


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs, each from its start on, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Encoder:
    """Encodes texts by a table of words (word, ids)."""

    def __init__(self, table: pa.Table, path: str) -> None:
        lists = table["ids"].combine_chunks()
        self.words, self.ids = table["word"].combine_chunks(), lists.flatten().to_numpy()
        self.offsets = lists.offsets.to_numpy().astype(np.int64) - (lists.offsets[0].as_py() if len(lists) else 0)
        self.tokenizer, self.pieces = tokenizer(path), pieces(path)

    def rows(self, words: pa.Array) -> tuple[np.ndarray, list[str]]:
        """The place of each word in the table, and the words that it lacks, whose places follow the table's and an empty one's."""
        found = pc.index_in(words, value_set=self.words)
        at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[pc.equal(words, "").to_numpy(zero_copy_only=False)] = len(self.words)
        rare = words.filter(pa.array(at < 0)).dictionary_encode()
        at[at < 0] = len(self.words) + 1 + rare.indices.to_numpy()
        return at, rare.dictionary.to_pylist()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin and end."""
        flat, bounds = chunks(texts)
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary
        # Two words for each chunk, the second often empty.
        at, rare = self.rows(pa.concat_arrays(split_chunks(distinct)))
        own = [e.ids for e in self.tokenizer.encode_batch(rare, add_special_tokens=False)]
        sizes = np.concatenate([np.diff(self.offsets), [0], np.fromiter(map(len, own), np.int64, len(own))]).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        every = np.concatenate([self.ids, np.fromiter(chain.from_iterable(own), np.int32, int(sizes[len(self.words) + 1 :].sum()))])
        pairs = at.reshape(2, -1).T.ravel()
        ids = every[runs(starts[pairs], sizes[pairs])]
        own_sizes = sizes[pairs].reshape(-1, 2).sum(axis=1)
        place = coded.indices.to_numpy()
        each = own_sizes[place]
        ends = np.concatenate([[0], np.cumsum(each)])
        return ids[runs((np.cumsum(own_sizes) - own_sizes)[place], each)], ends[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The pieces of each text's ids, joined by spaces as the library does for a tokenizer without a decoder."""
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), self.pieces.take(pa.array(ids)))
        return pc.binary_join(lists, " ").to_pylist()


def _encoded(docs: DataFrame, path: str, head_words: int, schema: str, made) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Only words that can get into the table are encoded for it.
    counts = stage(word_counts(docs, split_chunks), "bpe-counts")
    chosen = head(counts, ["word", "n"], head_words)
    table = encoded_words(spark.createDataFrame(chosen), path).select("word", "ids").toArrow()
    shared = spark.sparkContext.broadcast(table)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, path)
        for batch in slices(batches):
            ids, bounds = encoder.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made(ids, bounds, encoder.decode(ids, bounds))], names=names)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, ids, decoded) for every row of ``docs``; see :func:`encode_digests` for the cases."""
    return _encoded(docs, path, head_words, "doc_id long, ids array<int>, decoded string", lambda ids, bounds, texts: [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)), pa.array(texts, pa.string())])


def encode_digests(docs: DataFrame, path: str, head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``.

    Null and empty texts have no tokens and decode to the empty text.  Repeated rows, and rows with one doc_id or
    none, are encoded each on their own.  Columns besides doc_id and text are not used.  An empty table gives no rows.
    """

    def made(ids: np.ndarray, bounds: np.ndarray, texts: list[str]) -> list[pa.Array]:
        raw = ids.astype("<u4")
        digests = [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return [pa.array(np.diff(bounds)), pa.array(digests, pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())]

    return _encoded(docs, path, head_words, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", made)
