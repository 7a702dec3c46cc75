"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is p(class | context) p(member | class, context) ... p(word | leaf): a tree of choices among 16, as
deep as the vocabulary asks for.  Frequent words have a leaf of their own, all others share leaves by hash; within a leaf,
words go by their smoothed training counts, with one place for all unknown words.  Each choice is a softmax over a base,
the log frequency, and rows of weights hashed from the context: the word before, the word before that (a skip), both.

Training is synchronous.  A round adds up, over every training token of the corpus, the gradient of the log likelihood,
observed less expected counts by row, and then all weights take one step, scaled by the expected counts (the curvature).
Sums don't depend on how documents are dealt to tasks, and a round is one pass whatever the number of tasks.  The
first round's expected counts follow from the frequencies alone, so its pass only counts.  Rows grow with the training
tokens up to a bound, the depth of the tree with the distinct words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, stage
from .words import chunks, head, word_counts

#: Choices at each node of the tree.
WIDTH = 16
#: Levels of the tree by the number of distinct training words, up to which each depth is taken; beyond the last, one more.
DEPTHS = ((1 << 12, 2), (1 << 24, 3))
#: Share of the leaves that the most frequent words have each to themselves.
OWN = 0.75
#: Training tokens for each row of a level's weight tables, and the least and most rows of a level; the bound keeps the
#: weights of all levels, which are broadcast, under 50 MB.
TOKENS_PER_ROW = 64
LEAST_ROWS = 1 << 13
MOST_ROWS = 1 << 17
#: Context features (the word before, the word before that, both) and their share of the rows.
SHARES = (1 / 3, 1 / 3, 1 / 3)
#: Step of each round.
STEPS = (0.6, 0.4)
#: Tokens of the base's choices that are added to each row, so that rows seen once or twice move little.
EASE = 96.0
#: Tokens in one batch of the softmax.
BATCH = 1 << 16
#: Training tokens of one gradient task at least, and gradient tasks for each core at most: each task's sums are shuffled once.
TASK_TOKENS = 1 << 23
TASKS_PER_CORE = 32
#: The end of a text, counted as a token; no word has a space.
END = " "
HELD_OUT = 2
FOLDS = 7
#: Pieces of each level in which the sums of a round are added up, so that no task holds those of all tasks.
BLOCKS = 32

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.arange(8, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0x7FFFFFFF)


def word_hash(raw: bytes) -> int:
    return zlib.crc32(raw) & 0x7FFFFFFF


class Vocabulary:
    """The head words: count, hash and leaf of each; and the leaves' totals over all words."""

    def __init__(self, words: list[str], counts: list[int], depth: int) -> None:
        raw = [w.encode() for w in words]
        self.depth, self.leaves = depth, WIDTH**depth
        self.own = min(int(self.leaves * OWN), len(words))
        self.at = {w: i for i, w in enumerate(words)}
        self.log_count = np.log10(np.array([*counts, 0], float) + 1)
        self.count = np.array([*counts, 0], np.int64)
        self.hash = np.array([*map(word_hash, raw), 0], np.int64)
        self.leaf = np.where(np.arange(len(self.hash)) < self.own, np.arange(len(self.hash)), self.shared(self.hash))

    def shared(self, hashes: np.ndarray) -> np.ndarray:
        """The leaves of words without one of their own."""
        return self.own + hashes % (self.leaves - self.own)

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str]]]:
        """Of all tokens of all texts, end tokens too: code, text's number; and the words not in the head.

        A code is the word's number in the head, or the complement of its hash.
        """
        flat, bounds = chunks(texts, lower=True)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        codes = np.fromiter(map(self.at.get, distinct, [-1] * len(distinct)), np.int32, len(distinct))
        absent = np.flatnonzero(codes < 0)
        codes[absent] = np.fromiter((~word_hash(distinct[i].encode()) for i in absent.tolist()), np.int32, len(absent))
        # The end token of each text follows its words.
        place = np.ones(len(flat) + len(texts), bool)
        place[bounds[1:] + np.arange(len(texts))] = False
        out = np.full(len(place), self.at.get(END, ~word_hash(END.encode())), np.int32)
        at = coded.indices.to_numpy()
        out[place] = codes[at]
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds) + 1)
        loose = np.flatnonzero(codes[at] < 0)
        return out, owner, list(zip(owner[place][loose].tolist(), [distinct[i] for i in at[loose].tolist()], strict=True))

    def tokens(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and hash of each code."""
        known, rest = np.where(codes >= 0, codes, len(self.hash) - 1), ~codes.astype(np.int64)
        return np.where(codes >= 0, self.leaf[known], self.shared(np.abs(rest))), np.where(codes >= 0, self.hash[known], rest)


def contexts(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(features, tokens) hashes of each token's context within its own text; ``ends`` are the places of end tokens."""
    one, two = np.full(len(hashes), _NONE), np.full(len(hashes), _NONE)
    key = hashes.astype(np.uint64) + np.uint64(1)
    one[1:], two[2:] = key[:-1], key[:-2]
    first = ends[ends + 1 < len(hashes)] + 1
    one[first] = two[first] = _NONE
    two[first[first + 1 < len(hashes)] + 1] = _NONE
    mix = lambda x, salt: ((x ^ (x >> np.uint64(29))) * _MIX + np.uint64(salt)) * _MIX
    return np.stack([mix(one, 1), mix(two, 2), mix(mix(two, 3) ^ one, 4)])


class Shape:
    """Where the rows of each level lie: a node's rows follow one another, as many as its share of the tokens asks for."""

    def __init__(self, leaf_tokens: np.ndarray, depth: int, rows: int) -> None:
        self.depth = depth
        self.base, self.size, self.start, self.rows = [], [], [], []
        for level in range(depth):
            by_child = (leaf_tokens + 1.0).reshape(WIDTH**level, WIDTH, -1).sum(axis=2)
            by_node = by_child.sum(axis=1)
            self.base.append(np.log(by_child / by_node[:, None]).astype(np.float32))
            weight = by_node**0.75
            size = np.stack([np.maximum(1, np.floor(weight / weight.sum() * rows * s)) for s in SHARES]).astype(np.int64)
            self.size.append(size.astype(np.uint64))
            start = np.cumsum(size.ravel()) - size.ravel()
            self.start.append(start.reshape(size.shape).astype(np.uint64))
            self.rows.append(int(size.sum()))

    def choices(self, leaf: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The node and the choice that each leaf's path takes at a level."""
        return np.divmod(leaf // WIDTH ** (self.depth - 1 - level), WIDTH)

    def places(self, context: np.ndarray, node: np.ndarray, level: int) -> np.ndarray:
        """(features, tokens) rows of a level's table."""
        high = ((context + _SALTS[level]) * _MIX) >> np.uint64(32)
        return (self.start[level][:, node] + ((high * self.size[level][:, node]) >> np.uint64(32))).astype(np.int64)

    def piece(self, key: int) -> tuple[int, slice]:
        """The level and rows of a piece of the tables."""
        level, b = divmod(key, BLOCKS)
        return level, slice(b * self.rows[level] // BLOCKS, (b + 1) * self.rows[level] // BLOCKS)

    def features(self, level: int) -> list[slice]:
        """The rows of each feature."""
        ends = np.cumsum(self.size[level].sum(axis=1)).astype(int).tolist()
        return [slice(a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def row_nodes(self, level: int) -> np.ndarray:
        return np.repeat(np.tile(np.arange(WIDTH**level), len(SHARES)), self.size[level].ravel().astype(np.int64))

    def logits(self, weights: list[np.ndarray], rows: np.ndarray, node: np.ndarray, level: int) -> np.ndarray:
        z = np.take(self.base[level], node, axis=0)
        for own in rows:
            z += np.take(weights[level], own, axis=0)
        return z


def observed(shape: Shape, leaf: np.ndarray, context: np.ndarray, out: list[np.ndarray]) -> None:
    """Adds the observed choices by row to ``out``, flat tables of all levels."""
    for level in range(shape.depth):
        node, choice = shape.choices(leaf, level)
        at = shape.places(context, node, level) * WIDTH + choice
        out[level] += np.bincount(at.ravel(), minlength=len(out[level]))


def expected(shape: Shape, weights: list[np.ndarray], leaf: np.ndarray, context: np.ndarray, out: list[np.ndarray]) -> None:
    """Adds the choices that the model expects, by row, to ``out``, tables (choice, row) of all levels."""
    for a in range(0, len(leaf), BATCH):
        around = context[:, a : a + BATCH]
        for level in range(shape.depth):
            node, _ = shape.choices(leaf[a : a + BATCH], level)
            rows = shape.places(around, node, level)
            p = np.exp(shape.logits(weights, rows, node, level))
            p /= p.sum(axis=1, keepdims=True)
            each = np.ascontiguousarray(p.T, np.float64)
            for own, part in zip(rows, shape.features(level), strict=True):
                at = own - part.start
                for choice in range(WIDTH):
                    out[level][choice, part] += np.bincount(at, each[choice], part.stop - part.start)


def log10_leaf(shape: Shape, weights: list[np.ndarray], leaf: np.ndarray, context: np.ndarray) -> np.ndarray:
    """log10 p(leaf | context) of each token."""
    out = np.zeros(len(leaf))
    for a in range(0, len(leaf), BATCH):
        own, around = leaf[a : a + BATCH], context[:, a : a + BATCH]
        for level in range(shape.depth):
            node, choice = shape.choices(own, level)
            z = shape.logits(weights, shape.places(around, node, level), node, level)
            out[a : a + BATCH] += z[np.arange(len(own)), choice] - np.log(np.exp(z).sum(axis=1))
    return out / np.log(10)


def stepped(shape: Shape, key: int, weights: np.ndarray | None, seen: np.ndarray, likely: np.ndarray | None, rate: float) -> np.ndarray:
    """A piece's weights after a step: for each row and choice the log ratio of observed to expected, by the round's step.

    EASE tokens are added to each row, observed as the base has them and expected as the base and the row's weights do.
    Without weights, none are zero yet, what is expected follows from the base.
    """
    level, part = shape.piece(key)
    base = np.exp(shape.base[level].astype(np.float64))[shape.row_nodes(level)[part]]
    if weights is None:
        return (rate * np.log((seen + EASE * base) / ((seen.sum(axis=1, keepdims=True) + EASE) * base))).astype(np.float32)
    own = base * np.exp(weights)
    own /= own.sum(axis=1, keepdims=True)
    return (weights + rate * np.log((seen + EASE * base) / (likely + EASE * own))).astype(np.float32)


def vocabulary(docs: DataFrame) -> tuple[DataFrame, Vocabulary, np.ndarray, np.ndarray]:
    """The counts of all tokens of ``docs`` (a written table), the head, and the tokens and distinct words of each leaf."""
    ends = docs.groupBy().agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(END).alias("word"), "n")
    counts = stage(word_counts(docs, lower=True).unionByName(ends), "lm-counts")
    types = counts.count()
    found = head(counts, ["word", "n"])
    words, numbers = found["word"].to_pylist(), found["n"].to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-numbers[i], words[i]))
    words, numbers = [words[i] for i in order], [numbers[i] for i in order]
    made = Vocabulary(words, numbers, next((d for most, d in DEPTHS if types <= most), DEPTHS[-1][1] + 1))
    tokens, kinds = np.zeros(made.leaves), np.zeros(made.leaves)
    tokens[: made.own] = numbers[: made.own]
    own = counts.sparkSession.createDataFrame([(w,) for w in words[: made.own]], "word string")
    leaf = F.expr(f"(crc32(cast(word as binary)) & 2147483647) % {made.leaves - made.own} + {made.own}").alias("leaf")
    shared = counts.join(F.broadcast(own), "word", "left_anti").select(leaf, "n")
    for at, n, k in shared.groupBy("leaf").agg(F.sum("n"), F.count(F.lit(1))).collect():  # at most a row for each leaf
        tokens[at], kinds[at] = n, k
    return counts, made, tokens, kinds


def pieces(shape: Shape, tables: list[np.ndarray], kind: str, number: type) -> Iterator[pa.RecordBatch]:
    """The tables (row, choice) of all levels in pieces of some rows each."""
    for key in range(shape.depth * BLOCKS):
        level, part = shape.piece(key)
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([kind]), pa.array([tables[level][part].astype(number).tobytes()], pa.binary())], names=["key", "kind", "piece"])


def summed(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, str], np.ndarray]:
    """The sums of the pieces of one kind of each key; all pieces of a key meet in one task, which holds their sums only."""
    sums: dict[tuple[int, str], np.ndarray] = {}
    for batch in batches:
        for key, kind, piece in zip(batch.column("key").to_pylist(), batch.column("kind").to_pylist(), batch.column("piece"), strict=True):
            part = np.frombuffer(piece.as_buffer(), np.float32 if kind == "likely" else np.int32 if kind == "seen" else np.int64)
            at = (key, "seen" if kind == "total" else kind)
            if at not in sums:
                sums[at] = np.zeros(len(part), np.float64 if kind == "likely" else np.int64)
            sums[at] += part
    return sums


def decoded(batch: pa.RecordBatch, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf and context of all tokens of a batch of coded texts, and where each text ends."""
    column = batch.column("codes")
    codes = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in column])
    ends = np.cumsum(np.array([x.as_buffer().size // 4 for x in column]))
    leaf, hashes = words.tokens(codes)
    return leaf, contexts(hashes, ends - 1), ends


def trained(coded: DataFrame, words, shape: Shape, tokens: int) -> list[np.ndarray]:
    """Weights of each level after all rounds over ``coded`` (codes), the training texts.

    Sums are added up and steps taken by pieces, in tasks; only the weights, of bounded size, come to the driver and go to all.
    """
    spark = coded.sparkSession
    tasks = max(1, min(tokens // TASK_TOKENS, TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    texts, schema = coded.select("codes").coalesce(tasks), "key long, kind string, piece binary"
    plan = spark.sparkContext.broadcast(shape)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [np.zeros(n * WIDTH, np.int64) for n in plan.value.rows]
        for batch in slices(batches, "codes"):
            leaf, context, _ = decoded(batch, words.value)
            for a in range(0, len(leaf), BATCH):
                observed(plan.value, leaf[a : a + BATCH], context[:, a : a + BATCH], out)
        yield from pieces(plan.value, [x.reshape(-1, WIDTH) for x in out], "seen", np.int32)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _), part in summed(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array(["total"]), pa.array([part.tobytes()], pa.binary())], names=["key", "kind", "piece"])

    seen = stage(texts.mapInArrow(count, schema).repartition(BLOCKS, "key").mapInArrow(total, schema), "lm-seen")
    weights, rows = None, seen
    for turn, rate in enumerate(STEPS):
        now = spark.sparkContext.broadcast(weights)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            out = [np.zeros((WIDTH, n)) for n in plan.value.rows]
            for batch in slices(batches, "codes"):
                leaf, context, _ = decoded(batch, words.value)
                expected(plan.value, now.value, leaf, context, out)
            yield from pieces(plan.value, [x.T for x in out], "likely", np.float32)

        def step(batches: Iterator[pa.RecordBatch], now=now, rate=rate) -> Iterator[pa.RecordBatch]:
            sums = summed(batches)
            for key in sorted({k for k, _ in sums}):
                level, part = plan.value.piece(key)
                own = None if now.value is None else now.value[level][part]
                after = stepped(plan.value, key, own, *(None if (key, k) not in sums else sums[key, k].reshape(-1, WIDTH) for k in ("seen", "likely")), rate)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([after.tobytes()], pa.binary())], names=["key", "piece"])

        if turn:
            rows = seen.unionByName(texts.mapInArrow(expect, schema))
        found = rows.repartition(BLOCKS, "key").mapInArrow(step, "key long, piece binary").toLocalIterator()  # BLOCKS rows for each level
        weights = [np.zeros((n, WIDTH), np.float32) for n in shape.rows]
        for key, piece in found:
            level, part = shape.piece(key)
            weights[level][part] = np.frombuffer(piece, np.float32).reshape(-1, WIDTH)
        now.unpersist()
    return weights


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    Null and empty texts have the end token alone.  Documents with crc32(doc_id) mod 7 = 2 are held out; rows without a doc_id
    are training rows.  Wholly repeated rows are scored alike.  Without training rows all words are unknown.  An
    empty table gives no rows.  Columns besides doc_id and text are not used.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"))
    counts, vocabulary_, leaf_tokens, leaf_types = vocabulary(rows.where("not held_out"))
    words = spark.sparkContext.broadcast(vocabulary_)
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    leaf_log = np.log10(leaf_tokens + leaf_types + 1.0)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = words.value
        for batch in slices(batches):
            n = batch.num_rows
            codes, owner, rest = v.codes(batch.column("text"))
            known = np.where(codes >= 0, codes, len(v.hash) - 1)
            missing: list[list[str]] = [[] for _ in range(n)]
            for i, w in rest:
                missing[i].append(w)
            sizes = np.bincount(owner, minlength=n)
            each = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(4 * sizes)]).astype(np.int32)), pa.py_buffer(codes)])
            facts = [pa.array(sizes), pa.array(np.bincount(owner, v.count[known] > 0, n).astype(np.int64)), pa.array(np.bincount(owner, v.log_count[known], n)), pa.array(missing, pa.list_(pa.string())), each]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "tie", "held_out")), *facts], names=["doc_id", "tie", "held_out", "n_tokens", "known", "logs", "missing", "codes"])

    schema = "doc_id long, tie long, held_out boolean, n_tokens long, known long, logs double, missing array<string>, codes binary"
    coded = stage(rows.select("doc_id", F.xxhash64("text").alias("tie"), "held_out", "text").mapInArrow(code, schema), "lm-coded")
    level_rows = min(MOST_ROWS, max(LEAST_ROWS, 1 << max(0, total // TOKENS_PER_ROW - 1).bit_length()))
    shape = Shape(leaf_tokens, vocabulary_.depth, level_rows)
    model = spark.sparkContext.broadcast((shape, trained(coded.where("not held_out"), words, shape, total), leaf_log))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights, logs = model.value
        for batch in slices(batches, "codes"):
            leaf, context, ends = decoded(batch, words.value)
            by_leaf = np.add.reduceat(log10_leaf(plan, weights, leaf, context) - logs[leaf], np.concatenate([[0], ends[:-1]]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(by_leaf)], names=[*kept, "leaves"])

    kept = ["doc_id", "tie", "held_out", "n_tokens", "known", "logs"]
    parts = coded.select(*kept, "codes").mapInArrow(score, "doc_id long, tie long, held_out boolean, n_tokens long, known long, logs double, leaves double")
    # Words outside the head: looked up by a join, a row for each word and document, then summed for each document.
    # Equal (doc_id, text) have equal sums, so their first is that of each.
    loose = coded.where(F.size("missing") > 0).select("doc_id", "tie", "missing").dropDuplicates(["doc_id", "tie"])
    loose = loose.select("doc_id", "tie", F.explode("missing").alias("word")).groupBy("doc_id", "tie", "word").agg(F.count(F.lit(1)).alias("times"))
    found = loose.join(counts, "word").groupBy("doc_id", "tie").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    named = found.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), "more", "more_logs")
    whole = parts.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(float(total + types + 1)))).alias("base_score"), (logs + F.col("leaves")).alias("score"),
    )
