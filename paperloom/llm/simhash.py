"""SimHash near-duplicates by covering locality-sensitive hashing.

A pair of 64-bit fingerprints within ``radius`` bits must share a bucket: every bit position gets a vector of
``radius + 1`` bits, and each non-zero vector v names one table, whose mask keeps the positions whose vector has an
odd inner product with v.  The vectors of at most ``radius`` differing positions span less than the whole space, so
some v is orthogonal to all of them and its mask hides every difference.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, packed, slices, small_batches, stage, unpacked, words_of

BITS = 64
SEED = 42
#: Members that are compared within one bucket; larger buckets are split by further bits, never cut.
MOST_IN_BUCKET = 4096
#: Words in a shingle of the near-duplicate stage, and the Jaccard similarity of shingle sets from which texts are near-duplicates.
SHINGLE = 5
SIMILAR = (4, 5)
#: Least hashes are cut into bands; sets that agree in one band are compared.  At 0.8, (1 - 0.8 ** 5) ** 24, or 0.007 %, agree in none.
BANDS = 24
BAND_ROWS = 5
#: Differing bits of fingerprints of shingle sets from which a pair is a candidate whatever its least hashes; it must share a mask.
NEAR_BITS = 3
#: Least hashes, of all 120, that a pair must share before its sets are compared within a bucket: five standard deviations under 0.8.
SHARED = 74
#: Members of one bucket whose sets one task holds, and as many others; larger buckets are compared in pairs of such parts.
MOST_IN_PART = 256
#: Members of one part that are compared with as many others at once.
BLOCK = 256
#: Bits in the map of nodes whose sets are needed; the more nodes, the more sets are made in vain.
NODE_BITS = 1 << 24
#: Hashes whose bits are counted at once.
AT_ONCE = 1 << 16
_DRAWN = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * BAND_ROWS), np.uint64)
_SALTS, _FACTORS = _DRAWN[0], _DRAWN[1] | np.uint64(1)
_PLACE = np.random.default_rng(SEED + 1).integers(0, 2**64, SHINGLE, np.uint64) | np.uint64(1)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int) -> list[int]:
    """The 2^(radius+1)-1 masks.  Positions take the non-zero vectors in turn, so each mask keeps about half the bits."""
    d = radius + 1
    vector = [1 + i % ((1 << d) - 1) for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, 1 << d)]


def submasks(mask: int, radius: int) -> list[int]:
    """A mask, and one of radius+1 parts of the bits that it leaves out: of those parts one has no difference."""
    rest = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in rest[p :: radius + 1]) for p in range(radius + 1)]


def majority(hashes: Iterable[int]) -> int:
    """Bit i is 1 if it is set in over half of the hashes; none: zero."""
    bits, n, hashes = np.zeros(BITS, np.int64), 0, iter(hashes)
    while part := list(islice(hashes, AT_ONCE)):
        bits += np.unpackbits(np.array(part, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def shingle_hashes(words: list[bytes], size: int) -> Iterable[int]:
    """XXH64 of every run of ``size`` words joined by spaces, repeats included; the whole sequence if it is shorter."""
    if not words:
        return ()
    joined, ends = b" ".join(words), [e + i for i, e in enumerate(accumulate(map(len, words)))]
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = [0, *(e + 1 for e in ends[: len(words) - size])]
    digest = xxhash.xxh64_intdigest
    return (digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True))


def fingerprint(text: str | None, size: int = 3) -> int:
    return majority(shingle_hashes(words_of(text), size))


class _Hashes(dict):
    """XXH64 of words, remembered within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingle_set(text: str | None, hashes: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """A hash of a text's sequence of words, and the sorted hashes of its set of five-word shingles.

    Words are in lower case and without ASCII punctuation.  Fewer than five words are one shingle, none are no shingle.
    """
    words = plain_words(text)
    whole = whole_hash(words)
    return whole, shingle_set_of(words, whole, hashes)


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def whole_hash(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED)


def shingle_set_of(words: list[bytes], whole: int, hashes: dict[bytes, int]) -> np.ndarray:
    if len(words) < SHINGLE:
        return np.array([whole] if words else [], np.uint64)
    each = np.array([hashes[w] for w in words], np.uint64)
    n = len(each) - SHINGLE + 1
    runs = sum((each[k : n + k] * _PLACE[k] for k in range(1, SHINGLE)), each[:n] * _PLACE[0])
    return np.unique(_mixed(runs))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """For each of BANDS * BAND_ROWS hash functions its least value over the set: two sets share one with the chance of their Jaccard similarity."""
    out = np.full(len(_SALTS), np.uint64(2**64 - 1))
    for a in range(0, len(shingles), 1024):
        x = (shingles[a : a + 1024, None] ^ _SALTS) * _FACTORS
        out = np.minimum(out, (x ^ (x >> np.uint64(32))).min(axis=0))
    return out


def set_fingerprint(shingles: np.ndarray) -> np.uint64:
    """The fingerprint of a set of shingle hashes: bit i is 1 if it is set in over half of them."""
    bits = np.zeros(BITS, np.int64)
    for a in range(0, len(shingles), AT_ONCE):
        bits += np.unpackbits(shingles[a : a + AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * bits > len(shingles)).view(">u8").astype(np.uint64)[0]


def mask_keys(fp: np.uint64) -> np.ndarray:
    """A key for each covering mask: fingerprints within NEAR_BITS bits share at least one."""
    return _mixed(_mixed((fp & _COVERS) + _SALTS[BANDS : BANDS + len(_COVERS)]) + _SALTS[: len(_COVERS)])


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of least hashes."""
    return _mixed((least.reshape(BANDS, BAND_ROWS) * _FACTORS[:BAND_ROWS]).sum(axis=1, dtype=np.uint64) + _SALTS[:BANDS])


_COVERS = np.array(masks(NEAR_BITS), np.uint64)
_PLAIN = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def _map_texts(df: DataFrame, of, names: list[str]) -> DataFrame:
    """``df``'s rows with the longs that ``of`` gives for ``text`` in place of it."""
    kept = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [of(x.as_py()) for x in batch.column("text")]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + columns, names=kept + names)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text"] + [f"{n} long" for n in names]))


def _bucket_edges(radius: int):
    """Over rows (mask, key, fp, node) sorted by bucket: links each member to the first it is connected with there."""

    def links(fp: np.ndarray, node: np.ndarray, out: list) -> None:
        left = np.arange(len(fp))
        while len(left):
            root, queue, left = left[0], [left[0]], left[1:]
            while queue and len(left):
                i = queue.pop()
                near = np.bitwise_count(fp[left] ^ fp[i]) <= radius
                if near.any():
                    found = left[near]
                    out.append((node[found], np.full(len(found), node[root])))
                    queue.extend(found.tolist())
                    left = left[~near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            held = part if held is None else np.concatenate([held, part], axis=1)
            ends = np.flatnonzero((held[0, 1:] != held[0, :-1]) | (held[1, 1:] != held[1, :-1])) + 1
            if not len(ends):
                continue
            yield from emit(held[:, : ends[-1]], ends[:-1])
            held = held[:, ends[-1] :]
        if held is not None:
            ends = np.flatnonzero((held[0, 1:] != held[0, :-1]) | (held[1, 1:] != held[1, :-1])) + 1
            yield from emit(held, ends)

    def emit(rows: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds, out = [0, *cuts.tolist(), rows.shape[1]], []
        fp, node = rows[2].view(np.uint64), rows[3]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a > 1:
                links(fp[a:b], node[a:b], out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(2)], names=["a", "b"])

    return run


def fingerprint_links(nodes: DataFrame, radius: int = 3, most: int = MOST_IN_BUCKET) -> DataFrame:
    """Edges (a, b) that connect all of ``nodes`` (node, fp; the fp distinct) whose ``fp`` differ in ``radius`` bits or fewer.

    A bucket gives at most one edge per member.  Buckets with more than ``most`` members are split again by submasks, which keep the guarantee, until they fit:
    distinct fingerprints that agree in all but 12 bits are at most 4096.
    """
    spark = nodes.sparkSession
    level = masks(radius)
    made = F.explode(F.array(*[F.lit(signed(m)) for m in level]))
    rows = nodes.select("fp", "node", made.alias("mask")).withColumn("key", F.expr("fp & mask"))
    edges = None
    while True:
        counts = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        full = stage(rows.join(counts, ["mask", "key"]).select("mask", "key", "fp", "node", "n"), "buckets")
        fit = full.where((F.col("n") <= most) | (F.expr("bit_count(~mask)") <= 12)).select("mask", "key", "fp", "node")
        found = fit.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_bucket_edges(radius), "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        hot = full.where((F.col("n") > most) & (F.expr("bit_count(~mask)") > 12))
        if hot.isEmpty():
            return edges
        finer = {m: submasks(m, radius) for m in level}
        level = sorted({s for x in finer.values() for s in x})
        split = spark.createDataFrame([(signed(m), signed(s)) for m, x in finer.items() for s in x], "mask long, finer long")
        rows = hot.join(F.broadcast(split), "mask").select("fp", "node", F.col("finer").alias("mask")).withColumn("key", F.expr("fp & mask"))


def simhash_groups(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of whole texts: documents linked by fingerprints within ``radius`` bits, and over such links.

    Null texts count as empty; texts without words have fingerprint zero and link like any other.  Equal
    fingerprints are one node.  Rows that share a doc_id stay separate rows; a null doc_id never names a component unless
    nothing else is in it.  Columns besides doc_id and text are not used.
    """
    prints = stage(_map_texts(docs.select("doc_id", "text"), lambda t: (signed(fingerprint(t, size)),), ["fp"]), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).select(F.col("fp").alias("node"), "fp", "least")
    roots = components(fingerprint_links(nodes, radius))
    rooted = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _document() -> Column:
    """What names a document: whether it has no doc_id, the doc_id, and a hash of its text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"))


def _sketches(docs: DataFrame) -> DataFrame:
    """(node, least, keys) of each distinct sequence of words: its first document, and the keys of its bands and of its fingerprint under each mask.

    A document is (doc_id is null, doc_id, hash of the text); the first is the least of these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches):
            made = [shingle_set(t, hashes) for t in batch.column("text").to_pylist()]
            keys = [np.concatenate([band_keys(least_hashes(x)), mask_keys(set_fingerprint(x))]).view(np.int64) if len(x) else np.array([], np.int64) for _, x in made]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([signed(w) for w, _ in made], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc", "node", "keys"])

    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    prints = docs.select(_document().alias("doc"), "text").mapInArrow(run, f"doc struct<none:boolean,id:{id_type},tie:bigint>, node long, keys array<long>")
    return stage(prints.groupBy("node").agg(F.min("doc").alias("least"), F.first("keys").alias("keys")), "sketches")


def _shingle_sets(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, size, fp, sketch, shingles) of the nodes ``needed``: the number, fingerprint, least hashes and sorted hashes of their shingles.

    Texts are read where they lie.  A bitmap of the needed nodes, of a fixed size, leaves out most others; of those that pass
    by chance the join drops the rest.
    """
    bits = np.zeros(NODE_BITS, bool)
    bits[needed.select(F.pmod("node", F.lit(NODE_BITS)).cast("int").alias("bit")).distinct().toArrow().column("bit").to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, wanted = _Hashes(), np.unpackbits(shared.value).astype(bool)
        for batch in slices(batches):
            words = [plain_words(t) for t in batch.column("text").to_pylist()]
            made = [(w, shingle_set_of(x, w, hashes)) for x, w in ((x, whole_hash(x)) for x in words) if wanted[signed(w) % NODE_BITS]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([signed(w) for w, _ in made], pa.int64()), pa.array([len(x) for _, x in made], pa.int64()), pa.array([signed(int(set_fingerprint(x))) for _, x in made], pa.int64()),
                    pa.array([least_hashes(x).astype(np.uint32).tobytes() for _, x in made], pa.binary()), pa.array([x.tobytes() for _, x in made], pa.binary()),
                ],
                names=["node", "size", "fp", "sketch", "shingles"],
            )

    small_batches(docs.sparkSession)
    found = docs.select("text").mapInArrow(sets, "node long, size long, fp long, sketch binary, shingles binary")
    return stage(found.join(needed, "node", "left_semi").dropDuplicates(["node"]), "shingles")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.8 or more."""
    part, whole = SIMILAR
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return whole * shared >= part * (len(x) + len(y) - shared)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, x, y), the pairs (a, b) whose sets of shingles x and y are similar."""
    for batch in batches:
        keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _cross_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, parts, part, band, lead, node, root, size, fp, sketch, shingles) sorted by key and parts: verified links across a bucket's components.

    A group holds two parts of a bucket, or one of them, and its pairs are one of each.  Pairs with the bucket's lead have
    been compared, and pairs that share an earlier band, or any band or an earlier mask, are compared there.  Components that a link connects become one at
    once, so a group gives fewer links than it has members.
    """
    part, whole = SIMILAR

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lead, band = rows.column("lead")[0].as_py(), rows.column("band")[0].as_py()
        node, root, size, own = (rows.column(c).to_numpy() for c in ("node", "root", "size", "part"))
        across, fp = own.min() < own.max(), rows.column("fp").to_numpy().view(np.uint64)
        sketch = np.stack([np.frombuffer(x, np.uint32) for x in rows.column("sketch").to_pylist()])
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        root, out = root.copy(), []
        for i in range(0, len(node), BLOCK):
            for j in range(i, len(node), BLOCK):
                a, b = slice(i, i + BLOCK), slice(j, j + BLOCK)
                may = (root[a, None] != root[None, b]) & (node[a, None] != lead) & (node[None, b] != lead)
                if i == j:
                    may = np.triu(may, 1)
                if across:
                    may &= own[a, None] != own[None, b]
                may &= (whole * size[a, None] >= part * size[None, b]) & (whole * size[None, b] >= part * size[a, None])
                x, y = np.nonzero(may)
                x, y = x + i, y + j
                for k in range(0, len(x), 16384):
                    u, v = x[k : k + 16384], y[k : k + 16384]
                    same = sketch[u] == sketch[v]
                    shared = same.sum(axis=1)
                    agree = np.concatenate([same.reshape(-1, BANDS, BAND_ROWS).all(axis=2), ((fp[u] ^ fp[v])[:, None] & _COVERS) == 0], axis=1)
                    first = agree.argmax(axis=1)
                    near = np.flatnonzero((shared >= SHARED) & (first == band))
                    for at in near[np.argsort(-shared[near], kind="stable")]:
                        p, q = u[at], v[at]
                        if root[p] != root[q] and similar(sets[p], sets[q]):
                            out.append((node[p], node[q]))
                            root[root == root[q]] = root[p]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(out)[:, k]) for k in range(2)], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.stack([batch.column("key").to_numpy(), batch.column("parts").to_numpy()])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), keys.shape[1]]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and b > a and [held[0].column(c)[0].as_py() for c in ("key", "parts")] != keys[:, a].tolist():
                yield from links(pa.Table.from_batches(held))
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield from links(pa.Table.from_batches(held))


def near_duplicate_links(docs: DataFrame, nodes: DataFrame, most: int = MOST_IN_PART) -> DataFrame:
    """Links (a, b) of ``nodes`` with a Jaccard similarity of 0.8 or more that connect all such pairs within NEAR_BITS bits or which share a band.

    Buckets are those of the fingerprints under the covering masks, which miss no pair within NEAR_BITS bits, and those of the
    bands, which find similar pairs whose fingerprints are further apart.

    First each member of a bucket is compared with the bucket's smallest.  Buckets that still have several components are
    compared within, those of more than ``most`` members in pairs of parts, each pair a group of its own, so a group never holds
    more than two parts.  Every link is verified by the whole sets; a group gives at most one for each member.
    """
    rows = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    leads = rows.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "lead")
    members = stage(rows.join(leads, "key"), "buckets")
    sets = _shingle_sets(members.select("node").distinct(), docs)
    pairs = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    links = stage(both.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"), "near-links")
    rooted = members.join(components(links), "node", "left").select("key", "band", "lead", "node", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high and n > 2")
    # Parts are dealt by hash; a member goes to the groups of its part with every part, numbered by the two.
    several = several.select("key", F.ceil(F.col("n") / most).cast("long").alias("cut"))
    left = rooted.join(several, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("cut")))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1))).withColumn("parts", F.least("part", "other") * F.col("cut") + F.greatest("part", "other"))
    left = left.join(sets, "node").select("key", "parts", "part", "band", "lead", "node", "root", "size", "fp", "sketch", "shingles")
    return links.unionByName(left.repartition("key", "parts").sortWithinPartitions("key", "parts").mapInArrow(_cross_links, "a long, b long"))


def near_duplicates_removed(docs: DataFrame, most: int = MOST_IN_PART) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest doc_id, nulls last, ties by the text's hash.

    Texts are near-duplicates if their sets of five-word shingles have a Jaccard similarity of 0.8 or more, and over chains of
    such texts; case and ASCII punctuation don't count.  Texts of fewer than five words are one shingle; null and empty texts,
    and those without words, are duplicates of each other.  Of rows that share doc_id and text one stays.  Other columns
    pass through, whatever their names; an empty table gives no rows.
    """
    nodes = _sketches(docs)
    roots = components(near_duplicate_links(docs, nodes, most))
    rooted = nodes.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least")
    rows = packed(docs, doc=_document()).join(kept, F.col("doc") == F.col("least"), "left_semi")
    return unpacked(rows.groupBy("doc").agg(F.first("row").alias("row")), docs.columns)
