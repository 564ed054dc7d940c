"""What the nodes of pages carry, counted in full: every word pair of every node, as packed arrays.

A feature is a hash of BITS bits and the bits of its bucket. A task packs the
features of some pages by path, kind and bucket; Spark brings the rows of a
bucket together, and only sums over a node's features leave it again. Nothing is
left out, and a row holds hundreds of features where they are many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a feature within its bucket.
BITS = 40
#: Buckets grow with the pages, so that what one path has in one bucket does not; few make long lists, which pack well.
PAGES_PER_BUCKET = 8_000
MOST_BUCKET_BITS = 16
#: Bytes that are hashed at once, bytes of text that are packed at once (or one page), and features that are summed at once.
HASHED_BYTES = 1 << 18
PACKED_BYTES = 1 << 23
SUMMED_FEATURES = 1 << 19
#: Kinds of features.
FORM, CONTENT = 0, 1

_PACKED = "path bigint, kind int, bucket int, nodes array<bigint>, lengths array<int>, features binary, counts binary"
_SUMS = "path bigint, node bigint, kind int, n double, n_log double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _ramps(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. for each length, one after the other."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def word_pairs(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all neighbouring words, and of the word where a text has only one; single blanks separate words."""
    if not len(texts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    begins, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    blanks = np.flatnonzero(data == 32)
    starts = np.sort(np.concatenate([begins, blanks + 1]))
    stops = np.sort(np.concatenate([ends, blanks]))
    lengths = stops - starts
    hashes = np.empty(len(starts), np.uint64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(lengths) // HASHED_BYTES)) + 1).tolist(), len(starts)]
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        n = lengths[a:b]
        place = _ramps(n)
        byte = data[place + np.repeat(starts[a:b], n)]
        first = np.cumsum(n) - n
        hashes[a:b] = np.add.reduceat(_mix(place.astype(np.uint64) * np.uint64(256) + byte + np.uint64(1)), first)
    last = np.searchsorted(starts, ends, "left") - 1  # of each text
    text = np.repeat(np.arange(len(texts)), np.diff(last, prepend=-1))
    paired = np.ones(len(starts), bool)
    paired[last] = False
    single = last[np.diff(last, prepend=-1) == 1]
    at = np.flatnonzero(paired)
    pairs = _mix(_mix(hashes[at]) + hashes[at + 1])
    return np.concatenate([text[at], text[single]]), np.concatenate([pairs, _mix(hashes[single])])


def _pack(values: np.ndarray) -> bytes:
    """The low BITS bits of values in ascending runs: differences, as byte planes, compressed."""
    planes = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8]
    return zstandard.compress(np.ascontiguousarray(planes.T).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(BITS // 8, -1)
    values = np.zeros((planes.shape[1], 8), np.uint8)
    values[:, : BITS // 8] = planes.T
    return np.cumsum(values.view("<u8").reshape(-1)) & np.uint64((1 << BITS) - 1)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first one does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _by(group: np.ndarray, n_groups: int, key: np.ndarray) -> np.ndarray:
    """The order by group, then key; small numbers are sorted by their digits."""
    order = np.argsort(key)
    return order[np.argsort(group[order].astype(np.uint16 if n_groups <= 1 << 16 else np.int64), kind="stable")]


def _rows(kind: int, node: np.ndarray, path: np.ndarray, page: np.ndarray, value: np.ndarray, bucket_bits: int) -> pa.RecordBatch:
    """Packed rows of features (node, path, page, value); what repeats on a page counts once."""
    page_bits = np.uint64(64 - BITS - bucket_bits)
    nodes, first, number = np.unique(node, return_index=True, return_inverse=True)
    key = (value >> page_bits << page_bits) | page.astype(np.uint64)
    order = _by(number, len(nodes), key)
    number, key = number[order], key[order]
    once = _changes(number, key)
    number, value = number[once], key[once] >> page_bits
    runs = _changes(number, value)
    counts = np.diff(runs, append=len(value))
    number, value = number[runs], value[runs]
    bucket = (value >> np.uint64(BITS)).astype(np.int64)
    own = path[first]
    # Nodes of a path side by side, for each bucket of it.
    paths, path_of = np.unique(own, return_inverse=True)
    group = path_of[number] * (1 << bucket_bits) + bucket
    order = np.argsort(group, kind="stable")
    group, number, value, counts = group[order], number[order], value[order], counts[order]
    lists = _changes(group, number)
    rows = _changes(group)
    list_ends = np.searchsorted(lists, np.append(rows[1:], len(group)))
    ends = np.append(rows, len(group)).tolist()
    offsets = pa.array(np.append(0, list_ends), pa.int32())
    return pa.RecordBatch.from_pydict({
        "path": pa.array(paths[group[rows] >> bucket_bits], pa.int64()), "kind": pa.array(np.full(len(rows), kind), pa.int32()), "bucket": pa.array(group[rows] & ((1 << bucket_bits) - 1), pa.int32()),
        "nodes": pa.ListArray.from_arrays(offsets, pa.array(nodes[number[lists]], pa.int64())), "lengths": pa.ListArray.from_arrays(offsets, pa.array(np.diff(lists, append=len(group)), pa.int32())),
        "features": pa.array([_pack(value[a:b]) for a, b in zip(ends, ends[1:])], pa.binary()), "counts": pa.array([zstandard.compress(counts[a:b].astype("<u4").tobytes(), 1) for a, b in zip(ends, ends[1:])], pa.binary()),
    })


def _fields(structs: pa.ListArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The row of each struct, and the fields of all."""
    lengths = np.diff(np.asarray(structs.offsets))
    flat = structs.flatten()
    return np.repeat(np.arange(len(structs)), lengths), dict(zip((f.name for f in flat.type), flat.flatten()))


def packed(pages: DataFrame, bucket_bits: int) -> DataFrame:
    """Rows of features by path, kind and bucket, from pages with ``blocks`` and ``seen``."""
    most = 1 << min(64 - BITS - bucket_bits, 11)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            sizes = np.cumsum(batch.column("size").to_numpy(zero_copy_only=False))
            while at < batch.num_rows:
                end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PACKED_BYTES, "right"))
                end = min(max(end, at + 1), at + most)
                part, at = batch.slice(at, end - at), end
                page, seen = _fields(part.column("seen"))
                if not len(page):
                    continue
                node, path = (seen[c].to_numpy() for c in ("node", "path"))
                yield _rows(FORM, node, path, page, _mix(seen["form"].to_numpy().view(np.uint64)), bucket_bits)
                paths = dict(zip(node.tolist(), path.tolist()))
                page, blocks = _fields(part.column("blocks"))
                node = blocks["node"].to_numpy()
                text, value = word_pairs(blocks["text"])
                path = np.array([paths[n] for n in node.tolist()], np.int64)
                yield _rows(CONTENT, node[text], path[text], page[text], value, bucket_bits)

    size = F.aggregate("blocks", F.lit(0).cast("bigint"), lambda n, b: n + F.octet_length(b["text"])).alias("size")
    return pages.select("blocks", "seen", size).mapInArrow(run, _PACKED)


def _summed(rows: list[tuple], part: int = 0, part_bits: int = 0) -> pa.RecordBatch | None:
    """Sums over the features of whole buckets, or over those that begin with the bits ``part``: of a node by pages, and of a path by its nodes."""
    groups, nodes, values, counts = [], [], [], []
    numbers = _group_numbers(rows)
    for number, (_, _, _, own, lengths, features, times) in zip(numbers.tolist(), rows):
        value = _unpack(features)
        chosen = np.flatnonzero(value >> np.uint64(BITS - part_bits) == part)
        groups.append(np.full(len(chosen), number))
        nodes.append(np.repeat(np.array(own, np.int64), lengths)[chosen])
        values.append(value[chosen])
        counts.append(np.frombuffer(zstandard.decompress(times), "<u4")[chosen])
    group, value, counts = np.concatenate(groups), np.concatenate(values), np.concatenate(counts).astype(np.float64)
    if not len(group):
        return None
    nodes, node = np.unique(np.concatenate(nodes), return_inverse=True)
    n_groups = int(numbers[-1]) + 1
    key = (value << np.uint64(64 - BITS)) | node.astype(np.uint64)
    order = _by(group, n_groups, key)
    group, key, counts = group[order], key[order], counts[order]
    runs = _changes(group, key)
    c = np.add.reduceat(counts, runs)
    group, node, value = group[runs], node[order][runs], key[runs] >> np.uint64(64 - BITS)
    spots = _changes(group, value)
    h = np.diff(spots, append=len(value)).astype(np.float64)
    firsts = _changes(numbers)
    path, kind = np.array([rows[i][0] for i in firsts], np.int64), np.array([rows[i][1] for i in firsts], np.int32)
    own, where = np.unique(group * len(nodes) + node, return_inverse=True)
    of = own // len(nodes)
    spread = group[spots]
    return pa.RecordBatch.from_pydict({
        "path": pa.array(np.concatenate([path[of], path]), pa.int64()), "node": pa.array(nodes[own % len(nodes)].tolist() + [None] * n_groups, pa.int64()), "kind": pa.array(np.concatenate([kind[of], kind]), pa.int32()),
        "n": pa.array(np.concatenate([np.bincount(where, c), np.bincount(spread, h, n_groups)])), "n_log": pa.array(np.concatenate([np.bincount(where, c * np.log(c)), np.bincount(spread, h * np.log(h), n_groups)])),
    })


def _group_numbers(rows: list[tuple]) -> np.ndarray:
    """Numbers of the buckets of rows in order."""
    keys = np.array([r[:3] for r in rows], np.int64)
    new = np.zeros(len(rows), np.int64)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    return np.cumsum(new)


def sums(pages: DataFrame) -> DataFrame:
    """(path, node, kind, n, n_log): sums of c and c log c over the features of a node, which c pages carry, and of a path (node null), where c counts nodes.

    Rows of a node or path are partial; the rest is a sum. ``pages`` come with
    ``blocks`` (node, text) and ``seen`` (node, path, form), each node once.
    """
    bucket_bits = min(max(0, (pages.count() // PAGES_PER_BUCKET).bit_length()), MOST_BUCKET_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def done() -> Iterator[pa.RecordBatch]:
            part_bits = max(0, (n // SUMMED_FEATURES).bit_length() - 1)  # what is too much at once is read again by ranges
            for part in range(1 << part_bits):
                if (summed := _summed(held, part, part_bits)) is not None:
                    yield summed

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "kind", "bucket", "nodes", "lengths", "features", "counts"))):
                if n >= SUMMED_FEATURES and row[:3] != held[-1][:3]:
                    yield from done()
                    held, n = [], 0
                held.append(row)
                n += sum(row[4])
        if held:
            yield from done()

    buckets = packed(pages, bucket_bits).repartition("path", "kind", "bucket").sortWithinPartitions("path", "kind", "bucket")
    return buckets.mapInArrow(run, _SUMS)
