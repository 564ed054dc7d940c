"""Near duplicates: circulant MinHash, banding, and exact Jaccard verification of whole shingle sets."""

from __future__ import annotations

import hashlib
import sys
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlab.llm.common import arrow_batches, drop_stored, linked_heads, stored, text_or_empty
from cutlab.llm.components import connected_components

#: Signature coordinates: BANDS bands of ROWS minima. Two texts of Jaccard similarity 0.75 share no band with probability 1e-4.
BANDS, ROWS = 24, 4
#: Words in a shingle.
WORDS = 5
#: Bytes of text hashed at once.
WINDOW = 1 << 20
#: Documents of a bucket that meet others at once.
BLOCK = 128
#: Shingles of all documents of such a block, about; a longer document is a block of its own.
BLOCK_SHINGLES = 1 << 19
#: Bytes of texts and shingle sets that a task remembers.
CACHE_BYTES = 16 << 20
#: Rows that go to a Python worker at once: documents, pairs of documents, pairs of blocks.
DOCS, PAIRS, BLOCK_PAIRS = 1000, 500, 4
_RANDOM = np.random.default_rng(0xC0FFEE)
_BYTE_CODE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    n = WINDOW + 1
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word, in order. Words are runs without ASCII white space; A-Z count as a-z."""
    data, out, at = text.encode("utf-8", "surrogatepass").lower(), [], 0
    up, down = _powers()
    while at < len(data):
        end = min(len(data), at + WINDOW)
        if end < len(data):  # a window ends with a word, if it has a white space at all
            cut = max(data.rfind(bytes([s]), at, end) for s in (9, 10, 11, 12, 13, 32))
            if cut < 0:
                nexts = [p for s in (9, 10, 11, 12, 13, 32) if (p := data.find(bytes([s]), end)) >= 0]
                end = min(nexts, default=len(data))
                out.append(np.frombuffer(hashlib.blake2b(data[at:end], digest_size=8).digest(), "<u8"))
                at = end
                continue
            end = cut + 1
        a = np.frombuffer(data, np.uint8, end - at, at)
        space = np.concatenate(([True], _SPACE[a], [True]))
        starts = np.flatnonzero(space[:-1] & ~space[1:])
        stops = np.flatnonzero(~space[:-1] & space[1:])
        if len(starts):
            sums = np.zeros(len(a) + 1, np.uint64)
            np.cumsum(_BYTE_CODE[a] * up[: len(a)], out=sums[1:])
            out.append(_mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles; a text with fewer words is one shingle, one without words none."""
    w = word_hashes(text)
    if len(w) == 0:
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        h = h * _STEP + w[i : len(w) - k + 1 + i]
    return np.unique(_mix(h))


class Recent:
    """Shingle sets of the texts asked for last, as many as fit into ``most`` bytes; the last one always."""

    def __init__(self, words: int, most: int = CACHE_BYTES) -> None:
        self.words, self.most, self.bytes = words, most, 0
        self.sets: OrderedDict[str, np.ndarray] = OrderedDict()

    def __call__(self, text: str) -> np.ndarray:
        if text in self.sets:
            self.sets.move_to_end(text)
            return self.sets[text]
        found = self.sets[text] = shingle_set(text, self.words)
        self.bytes += sys.getsizeof(text) + found.nbytes
        while self.bytes > self.most and len(self.sets) > 1:
            old, gone = self.sets.popitem(last=False)
            self.bytes -= sys.getsizeof(old) + gone.nbytes
        return found


def circulant_minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """n MinHash coordinates from two permutations of 32-bit numbers.

    The first permutation scatters the shingles; the second, shifted circularly
    by k places, gives coordinate k.
    """
    first = (_mix(shingles * np.uint64(0xA24BAED4963EE407)) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(n, dtype=np.uint32)[:, None]
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    wide = max(1, 32768 // n)
    x, y = np.empty((2, n, min(wide, max(1, len(first)))), np.uint32)
    for at in range(0, len(first), wide):
        part = first[None, at : at + wide]
        if part.shape[1] < x.shape[1]:
            x, y = x[:, : part.shape[1]], y[:, : part.shape[1]]
        np.subtract(part, shift, out=x)
        np.multiply(x, np.uint32(0x85EBCA6B), out=x)
        np.right_shift(x, np.uint32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0xC2B2AE35), out=x)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64) * _BASE
    for r in range(rows):
        h = _mix(h * _STEP + minima.reshape(bands, rows)[:, r].astype(np.uint64))
    return h.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, set_hash, bands): one row per document; set_hash and bands are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, keys = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), words)
                n.append(len(s))
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(circulant_minima(s, bands * rows), bands, rows) if len(s) else None)
            columns = {"id": batch.column("id"), "n_shingles": pa.array(n, pa.int64()), "set_hash": pa.array(names, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(columns)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(run, "id long, n_shingles long, set_hash binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose whole shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Recent(words)
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("text_a"), batch.column("text_b")):
                x, y = shingles(a.as_py()), shingles(b.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest id reachable by links, and kept
    marks that document. A null or blank text has an empty set and links with
    nothing; texts with equal sets form a class that goes on as one; rows that
    repeat an id are one vertex, linked if any of their texts is. A null id
    belongs with equal sets and is otherwise like nothing. An empty table gives
    no rows; other columns do not matter.

    The smallest member of every bucket, its head, meets all others, so that
    copies, however many, cost one pair each. Where the others still span
    components they meet each other, in blocks, but for those of the bucket's
    largest component among themselves. So a bucket costs its size times the
    number of members outside of that component. Buckets with the same members
    are taken once. A worker remembers the sets of CACHE_BYTES of texts and gets
    few rows at a time, so its memory grows with the longest text alone.
    """
    spark = docs.sparkSession
    with arrow_batches(spark, DOCS):
        sig = stored(signatures(docs, id_col, text_col, words, bands, rows))
    filled = sig.filter("set_hash is not null").select("id", "n_shingles", "set_hash")
    classes = stored(filled.groupBy("set_hash").agg(F.min("id").alias("rep")))
    reps = sig.join(classes, (sig.set_hash == classes.set_hash) & (sig.id == classes.rep), "left_semi")
    left = stored(_several(reps.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))))

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    texts = stored(texts.join(left.select("id").distinct(), "id", "left_semi"))

    with arrow_batches(spark, PAIRS):
        met = stored(_met_by_heads(left, texts, words, percent))
    component = connected_components(met)
    buckets, left = left, _spanning(left, component)
    drop_stored(buckets)
    if not left.isEmpty():
        with arrow_batches(spark, BLOCK_PAIRS):
            more = stored(_met_in_blocks(left, texts, words, percent))
        component = connected_components(component.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    drop_stored(left, texts)

    out = filled.join(classes, "set_hash").select("id", "n_shingles", "rep")
    out = out.join(component.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    empty = sig.filter("set_hash is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return out.unionByName(empty).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _heads(rows: DataFrame) -> DataFrame:
    """(bucket, a, lead_n): the smallest id of each bucket, and its number of shingles; stored, so that a join with it can split a large bucket."""
    heads = rows.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("h"))
    return stored(heads.select("bucket", F.col("h.id").alias("a"), F.col("h.n").alias("lead_n")))


def _met_by_heads(rows: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links between the head of every bucket and the others, from rows (bucket, id, n)."""
    fits = F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * percent
    pairs = rows.withColumnRenamed("id", "b").join(_heads(rows), "bucket").filter(fits & (F.col("a") != F.col("b")))
    return _verified(pairs.select("a", "b").distinct(), texts, words, percent)


def _spanning(rows: DataFrame, component: DataFrame) -> DataFrame:
    """(bucket, block, id, component), stored: the members, but for the heads, of buckets that span components without them.

    Blocks below zero hold members of the bucket's largest component, the others all the rest.
    """
    left = rows.join(_heads(rows).select("bucket", F.col("a").alias("head")), "bucket").filter("id <> head").select("bucket", "id", "n")
    left = stored(left.join(component.select("id", F.col("component").alias("c")), "id", "left").select("bucket", "id", "n", F.coalesce("c", "id").alias("component")))
    parts = left.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.sum("n").alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    each = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("k").alias("k"), F.sum("size").alias("size"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max(F.struct("k", "size", "component")).alias("top"))
    one = each.filter("parts > 1").groupBy("k", "size", "x", "y").agg(F.min(F.struct("bucket", "top")).alias("b"))
    blocks = lambda k, size: F.ceil(F.greatest(k / BLOCK, size / BLOCK_SHINGLES)).cast("int")
    top = F.col("b.top")
    one = stored(one.select("b.bucket", top["component"].alias("top"), blocks(top["k"], top["size"]).alias("inside"), blocks(F.col("k") - top["k"], F.col("size") - top["size"]).alias("outside")))
    mixed = F.xxhash64("id")
    block = F.when(F.col("component") == F.col("top"), -1 - F.pmod(mixed, F.col("inside"))).otherwise(F.pmod(mixed, F.col("outside"))).cast("int")
    out = stored(left.join(one, "bucket").select("bucket", block.alias("block"), "id", "component"))
    drop_stored(left, one)
    return out


def _met_in_blocks(left: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links that connect the components of every bucket, from rows (bucket, block, id, component).

    A block holds about BLOCK documents of a bucket, fewer where they are long. Tasks take pairs of blocks
    of a bucket, count the shared shingles of all their documents at once, and
    return one link a document, to the head of what it is connected with there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Recent(words)
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for row in range(batch.num_rows):
                x, y = batch.column("docs_a")[row].as_py(), batch.column("docs_b")[row].as_py()
                sets_x, sets_y = [shingles(d["text"]) for d in x], [shingles(d["text"]) for d in y]
                n_x, n_y = (np.array([len(s) for s in sets]) for sets in (sets_x, sets_y))
                both = shared_counts(sets_x, sets_y)
                near = 100 * both >= percent * (n_x[:, None] + n_y[None, :] - both)
                near &= np.array([d["component"] for d in x])[:, None] != np.array([d["component"] for d in y])[None, :]
                if near.any():
                    ids_x, ids_y = np.array([d["id"] for d in x]), np.array([d["id"] for d in y])
                    head_x, head_y = linked_heads(near, ids_x, ids_y)
                    found += [(ids_x[near.any(axis=1)], head_x[near.any(axis=1)]), (ids_y[near.any(axis=0)], head_y[near.any(axis=0)])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b"])

    blocks = left.join(texts, "id").groupBy("bucket", "block").agg(F.collect_list(F.struct("id", "component", "text")).alias("docs"))
    blocks = stored(blocks)
    names = blocks.select("bucket", "block")
    pairs = names.withColumnRenamed("block", "block_a").join(names.withColumnRenamed("block", "block_b"), "bucket").filter("block_a <= block_b and block_b >= 0")
    for s in "ab":
        pairs = pairs.join(blocks.select("bucket", F.col("block").alias(f"block_{s}"), F.col("docs").alias(f"docs_{s}")), ["bucket", f"block_{s}"])
    return pairs.select("docs_a", "docs_b").mapInArrow(run, "a long, b long")


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of x shares with each set of y; a slice of the elements at a time."""

    def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (v_x, i_x), (v_y, i_y) = flat(x), flat(y)
    names = np.intersect1d(v_x, v_y)
    out = np.zeros((len(x), len(y)), np.int64)
    for at in range(0, len(names), 4096):
        part = names[at : at + 4096]
        sides = []
        for v, i, n in ((v_x, i_x, len(x)), (v_y, i_y, len(y))):
            k = np.minimum(np.searchsorted(part, v), len(part) - 1)
            hit = part[k] == v
            m = np.zeros((n, len(part)), np.float32)
            m[i[hit], k[hit]] = 1
            sides.append(m)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return out


def _several(rows: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one id."""
    shared = rows.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("bucket")
    return rows.join(stored(shared), "bucket", "left_semi")
