"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND, and a check of word overlap.

The items are the indexed documents, in blocks; every training passage is a query.  Impacts are divided by the item's
score for itself, so that one threshold, a share of the best possible score, holds for all items.  A passage is skipped at
the pivot test when the largest impacts of its terms over all items can't add up to the threshold, a block when those
over its items can't; only items of blocks that remain are scored.  All items at or above the threshold are
retrieved, with no top k.  Passages overlap: windows of two strides with a stride of the longest item, so an item's text lies
whole in one of them wherever it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, slices, small_batches, unpacked

K1 = 1.2
B = 0.75
#: Share of an item's own score at which a passage's match is retrieved.
MIN_SHARE = 0.6
#: Share of the question's five-word shingles that the passage must contain, and of the answer's words.
MIN_QUESTION = 0.8
MIN_ANSWER = 0.8
SHINGLE = 5
#: Items in one block of the index.
BLOCK = 8
#: The index, some five times the items, is broadcast; a benchmark of more bytes is searched in several passes of about so many.
MOST_BENCHMARK_BYTES = 64 << 20
#: Items of up to so many words share an index, and so the length of its passages; longer ones have a further index each.
LENGTHS = (256, 2048, 16384)

_WORDS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text in lower case, ASCII punctuation as white space."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_WORDS).split()


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence is its answer, all before it the question; an item of one sentence is all question."""
    parts = [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if words(x)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


@dataclass
class Index:
    """Terms have ids from 0.  A term's postings name the blocks that hold it, with its largest impact in each."""

    items: list
    terms: dict[bytes, int]
    most: np.ndarray  # by term: the largest impact over all items
    starts: np.ndarray  # by term: where its postings begin; one more for the end
    posted: np.ndarray  # by posting: the block
    posted_most: np.ndarray  # by posting: the largest impact in the block
    block_terms: list[np.ndarray]  # by block: its terms in order
    impact: list[np.ndarray]  # by block: terms x items
    stride: int
    question: list[set]
    answer: list[set]


def build_indexes(items: list[tuple[int, str]]) -> list[Index]:
    """An index for each class of lengths, so that one long item doesn't make the passages of all others long."""
    sizes = [sum(len(words(t)) > most for most in LENGTHS) for _, t in items]
    made = [build_index([x for x, own in zip(items, sizes, strict=True) if own == k]) for k in range(len(LENGTHS) + 1)]
    return [x for x in made if x]


def build_index(items: list[tuple[int, str]], block: int = BLOCK) -> Index | None:
    """The index of items (item_id, text) with words; none if no item has any.  Similar items share a block by their rarest words."""
    split = [(i, words(t), t) for i, t in items if t and words(t)]
    if not split:
        return None
    df: dict[bytes, int] = {}
    for _, w, _ in split:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    split.sort(key=lambda x: (min(x[1], key=lambda w: (df[w], w)), x[0] is None, x[0]))
    terms = {w: i for i, w in enumerate(sorted(df))}
    n, mean = len(split), sum(len(w) for _, w, _ in split) / len(split)
    idf = {w: np.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    block_terms, impact = [], []
    for b in range(0, n, block):
        own = split[b : b + block]
        used = np.array(sorted({terms[x] for _, w, _ in own for x in w}), np.int64)
        row = {t: i for i, t in enumerate(used.tolist())}
        made = np.zeros((len(used), len(own)), np.float32)
        for j, (_, w, _) in enumerate(own):
            score = {x: idf[x] * (tf := w.count(x)) * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean)) for x in set(w)}
            total = sum(score.values())
            for x, s in score.items():
                made[row[terms[x]], j] = s / total
        block_terms.append(used)
        impact.append(made)
    flat = np.concatenate(block_terms)
    order = np.argsort(flat, kind="stable")
    largest = np.concatenate([m.max(axis=1) for m in impact])[order]
    posted = np.repeat(np.arange(len(impact)), [len(t) for t in block_terms])[order]
    starts = np.searchsorted(flat[order], np.arange(len(terms) + 1))
    pairs = [question_and_answer(t) for _, _, t in split]
    stride = max(32, *(len(w) for _, w, _ in split))
    return Index([i for i, _, _ in split], terms, np.maximum.reduceat(largest, starts[:-1]), starts, posted, largest, block_terms, impact, stride, [shingles(words(q)) for q, _ in pairs], [set(words(a)) for _, a in pairs])


def shingles(w: list[bytes], size: int = SHINGLE) -> set:
    """Runs of ``size`` words; of fewer words the whole run, none of no words."""
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def search(index: Index, ids: np.ndarray, share: float = MIN_SHARE) -> list[tuple[int, int, float]]:
    """(passage, item's number, share of its score) for all items that some passage of ``ids`` reaches; -1: no term."""
    passages = max(1, -(-len(ids) // index.stride) - 1)
    at = np.flatnonzero(ids >= 0)
    if not len(at):
        return []
    terms, half = ids[at].astype(np.int64), at // index.stride
    spread = np.unique(np.concatenate([np.minimum(half, passages - 1), np.maximum(half - 1, 0)]) * len(index.terms) + np.concatenate([terms, terms]))
    passage, term = np.divmod(spread, len(index.terms))
    # Pivot test: can all lists together reach the threshold?
    able = np.bincount(passage, index.most[term], passages) >= share - 1e-6
    kept = able[passage]
    if not kept.any():
        return []
    passage, term = passage[kept], term[kept]
    # Block test: the postings of each passage's terms add up their blocks' largest impacts.
    n = index.starts[term + 1] - index.starts[term]
    at = np.arange(int(n.sum())) + np.repeat(index.starts[term] - (np.cumsum(n) - n), n)
    blocks = len(index.impact)
    cell = np.repeat(passage, n) * blocks + index.posted[at]
    if passages * blocks <= 8 * len(cell) + (1 << 16):
        hopeful = np.flatnonzero(np.bincount(cell, index.posted_most[at]) >= share - 1e-6)
    else:  # few of all cells have postings
        keys, where = np.unique(cell, return_inverse=True)
        hopeful = keys[np.bincount(where, index.posted_most[at]) >= share - 1e-6]
    begin = np.searchsorted(passage, np.arange(passages + 1))
    found = []
    for p, b in zip(*(x.tolist() for x in np.divmod(hopeful, blocks)), strict=True):
        own = term[begin[p] : begin[p + 1]]
        rows = np.searchsorted(index.block_terms[b], own)
        rows = rows[index.block_terms[b][np.minimum(rows, len(index.block_terms[b]) - 1)] == own]
        score = index.impact[b][rows].sum(axis=0)
        found += [(p, b * BLOCK + j, float(score[j])) for j in np.flatnonzero(score >= share - 1e-6).tolist()]
    return found


def verified(index: Index, item: int, passage: list[bytes]) -> tuple[float, float]:
    """The shares of the item's question shingles and answer words that the passage has; 1 where the item has none."""
    q, a = index.question[item], index.answer[item]
    have, bag = {tuple(passage[i : i + k]) for k in {len(x) for x in q} for i in range(len(passage) - k + 1)}, set(passage)
    return (len(q & have) / len(q) if q else 1.0), (len(a & bag) / len(a) if a else 1.0)


def matches(rows: DataFrame, benchmark: DataFrame, share: float, most: int) -> DataFrame:
    """(doc, item_id, score, question_overlap, answer_overlap): every item that a row of ``rows`` (doc, text) leaks, by its best passage."""
    spark = rows.sparkSession
    small_batches(spark)
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // most))
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, item_id long, score double, question_overlap double, answer_overlap double"
    found = None
    for turn in range(passes):
        share_of = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == turn)
        items = share_of.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").collect()  # about ``most`` bytes
        shared = spark.sparkContext.broadcast(build_indexes([(r[0], r[1]) for r in items if r[1]]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches) if shared.value else ():
                hits = []
                for at, text in enumerate(batch.column("text").to_pylist()):
                    w = words(text)
                    for index in shared.value:
                        ids = np.fromiter(map(index.terms.get, w, [-1] * len(w)), np.int32, len(w))
                        best: dict[int, tuple] = {}
                        for p, item, score in search(index, ids, share):
                            q, a = verified(index, item, w[p * index.stride : (p + 2) * index.stride])
                            if q >= MIN_QUESTION and a >= MIN_ANSWER:
                                best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (score, q, a))
                        hits += [(at, index.items[i], *x) for i, x in best.items()]
                if hits:
                    doc = batch.column("doc").take(pa.array([h[0] for h in hits]))
                    rest = [pa.array([h[i] for h in hits], pa.int64() if i == 1 else pa.float64()) for i in range(1, 5)]
                    yield pa.RecordBatch.from_arrays([doc, *rest], names=["doc", "item_id", "score", "question_overlap", "answer_overlap"])

        own = rows.select("doc", "text").mapInArrow(run, schema)
        found = own if found is None else found.unionByName(own)
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = MIN_SHARE, most: int = MOST_BENCHMARK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): every item that a document leaks, by its best passage.

    Null and empty texts leak nothing; items without words are never leaked.  Repeated rows, of either table, give a row
    each.  A benchmark of more than ``most`` bytes is dealt by hash to several indexes, each item to one, whose weights are
    those of its own share; every document is searched in all.  An empty benchmark or table gives no rows.  Columns
    besides doc_id, item_id and text are not used.
    """
    return matches(docs.select(F.col("doc_id").cast("long").alias("doc"), "text"), benchmark, share, most).withColumnRenamed("doc", "doc_id")


def decontaminated(docs: DataFrame, benchmark: DataFrame, share: float = MIN_SHARE, most: int = MOST_BENCHMARK_BYTES) -> DataFrame:
    """``docs`` without the rows that leak an item, nulls and repeats of doc_id told apart by their texts.

    Null and empty texts stay.  All columns pass through, whatever their names; an empty benchmark removes nothing.
    """
    document = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"))
    leaked = matches(docs.select(document.alias("doc"), "text"), benchmark, share, most).select(F.col("doc").alias("leak")).distinct()
    return unpacked(packed(docs, doc=document).join(leaked, F.col("doc") == F.col("leak"), "left_anti"), docs.columns)
