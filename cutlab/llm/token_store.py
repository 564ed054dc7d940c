"""Token ids as a binary store: fixed-size blocks of ids, split into byte planes, each plane compressed.

A chunk holds the ids of whole documents, one after the other, up to about
CHUNK_IDS of them. It is cut into blocks of BLOCK_IDS ids; the bytes of a block
are transposed, so that all low bytes come first, then the second bytes and so
on, and each plane is a zstandard frame. Its layout, little-endian:

    4 bytes "IDP1", u32 ids, u32 blocks, u32 planes
    blocks * planes * u32: compressed length of each plane (the chunk index)
    the planes

Chunks are rows of a Parquet table (shard, chunk, start in the shard, ids,
documents with their lengths, bytes), since Spark's writers commit whole tasks
only: a task that is lost leaves no half-written file, and any store that Spark
reads will do.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cutlab.llm.bpe import _SEPARATORS, _WHITE, CACHE_WORDS, Encoder, Remembered, Vocabulary
from cutlab.llm.common import scratch_folder, text_or_empty

BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 20
#: Words of a text that are encoded at once.
STEP_WORDS = 1 << 16
_HEAD = struct.Struct("<4sIII")
_MAGIC = b"IDP1"


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS, level: int = 3) -> bytes:
    """A chunk from unsigned 32-bit ids."""
    ids = np.ascontiguousarray(ids, "<u4")
    press = zstandard.ZstdCompressor(level=level)
    planes = []
    for at in range(0, len(ids), block_ids):
        block = ids[at : at + block_ids].view(np.uint8).reshape(-1, 4)
        planes += [press.compress(np.ascontiguousarray(block[:, k]).tobytes()) for k in range(4)]
    index = np.array([len(p) for p in planes], "<u4").tobytes()
    return b"".join([_HEAD.pack(_MAGIC, len(ids), len(planes) // 4, 4), index, *planes])


def unpack(chunk: bytes, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """The ids of a chunk."""
    magic, n, blocks, planes = _HEAD.unpack_from(chunk)
    if magic != _MAGIC:
        raise ValueError("not a chunk of token ids")
    sizes = np.frombuffer(chunk, "<u4", blocks * planes, _HEAD.size).tolist()
    out, at, press = np.zeros((n, 4), np.uint8), _HEAD.size + 4 * blocks * planes, zstandard.ZstdDecompressor()
    for b in range(blocks):
        rows = out[b * block_ids : (b + 1) * block_ids]
        for k in range(planes):
            size = sizes[b * planes + k]
            rows[:, k] = np.frombuffer(press.decompress(chunk[at : at + size]), np.uint8)
            at += size
    return out.view("<u4").reshape(-1)


class BulkEncoder(Encoder):
    """An encoder that normalises and cuts all words of a text that it does not remember at once."""

    def __init__(self, vocabulary: Vocabulary, merge: Callable[[str], list[int]]) -> None:
        super().__init__(vocabulary, merge)
        self.piece = Remembered(lambda p: struct.pack(f"<{len(ids := merge(p))}I", *ids))
        self.cut = regex.compile(f"{vocabulary.split.pattern}|\n")
        self.bytes = {b: s for b, s in enumerate(vocabulary.symbols) if b not in b"\t\n"}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        words = _WHITE.split(text) if any(c in text for c in _SEPARATORS) else text.split()
        return b"".join([self._words(words[at : at + STEP_WORDS]) for at in range(0, len(words), STEP_WORDS)])

    def _words(self, words: list[str]) -> bytes:
        """The ids of some words; two generations of words are remembered, long ones never."""
        known, new = self.known, []
        for word in set(words).difference(known):
            if (ids := self.old.get(word)) is None:
                new.append(word)
            else:
                known[word] = ids
        if new:
            known.update(zip(new, self._new(new)))
        out = b"".join(map(known.__getitem__, words))
        for word in new:
            if len(word) > 64:
                del known[word]
        if len(known) >= CACHE_WORDS:
            self.old, self.known = known, {}
        return out

    def _new(self, words: list[str]) -> list[bytes]:
        text, piece = "\n".join(words), self.piece
        if not text.isascii():
            if any(unicodedata.category(c) in ("Cn", "Co") for c in set(text)):  # as pieces() has it, word by word
                return [b"".join([piece[p] for p in self.vocabulary.pieces(w)]) for w in words]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        pieces = "\t".join(self.cut.findall(text.lower())).encode("utf-8").decode("latin-1").translate(self.bytes).split("\t")
        out: list[bytes] = []
        own: list[bytes] = []
        for p in pieces:
            if p == "\n":
                out.append(b"".join(own))
                own = []
            else:
                own.append(piece[p])
        return [*out, b"".join(own)]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> Encoder:
    """The tokenizers library's merges for every word that a worker has not seen lately."""
    model = Tokenizer.from_file(path).model
    return BulkEncoder(Vocabulary(path), lambda piece: [t.id for t in model.tokenize(piece)])


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends ``end_id``, and stores the ids in ascending id order.

    A null text counts as empty and gives the end id alone; null ids come first;
    rows that repeat an id follow each other, ordered by their text. Texts are
    range-partitioned by id before they are encoded, so that each is encoded once;
    a partition is a shard. A document longer than a chunk has a chunk of its own.
    Other columns are left out; an empty table gives a store without chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = library_encoder(tokenizer), np.uint32(end_id).tobytes()
        shard, number, start = None, 0, 0
        names: list[int | None] = []
        held: list[bytes] = []
        n = 0

        def chunk() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            columns = {
                "shard": pa.array([shard], pa.int32()), "chunk": pa.array([number], pa.int32()), "start": pa.array([start], pa.int64()), "n_ids": pa.array([n], pa.int64()),
                "ids_of": pa.array([names], pa.list_(pa.int64())), "lengths": pa.array([[len(h) // 4 for h in held]], pa.list_(pa.int64())), "planes": pa.array([pack(ids)], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for name, text, part in zip(*(batch.column(c) for c in ("id", "text", "shard"))):
                ids = enc.encode(text.as_py()) + end
                shard = part.as_py()
                if held and n + len(ids) // 4 > CHUNK_IDS:
                    yield chunk()
                    number, start, n = number + 1, start + n, 0
                    names, held = [], []
                names.append(name.as_py())
                held.append(ids)
                n += len(ids) // 4
        if held:
            yield chunk()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text").withColumn("shard", F.spark_partition_id())
    schema = "shard int, chunk int, start long, n_ids long, ids_of array<long>, lengths array<long>, planes binary"
    rows.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark, path: str, content: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the store: id, start (ids of all documents before it), n_tokens, ids_crc32 and, with ``content``, ids.

    Where a shard begins comes from a running sum over one number a shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = {c: batch.column(c)[row].as_py() for c in ("begin", "start", "ids_of", "lengths", "planes")}
                ids, lengths = unpack(chunk["planes"]), np.array(chunk["lengths"], np.int64)
                ends = np.cumsum(lengths)
                parts = [ids[e - k : e] for e, k in zip(ends, lengths)]
                columns = {
                    "id": pa.array(chunk["ids_of"], pa.int64()), "start": pa.array(chunk["begin"] + chunk["start"] + ends - lengths, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                }
                if content:
                    columns["ids"] = pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    store = spark.read.parquet(path)
    shards = store.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begin = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    # One row a shard, and a shard is a partition of the writing job: small for any number of documents.
    rows = store.join(F.broadcast(begin), "shard").select("begin", "start", "ids_of", "lengths", "planes")
    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * content
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def stored_ids(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", content: bool = False) -> DataFrame:
    """Writes the store to a new shared folder and reads it back."""
    path = scratch_folder(docs.sparkSession)
    write_ids(docs, path, tokenizer, end_id, id_col, text_col)
    return read_ids(docs.sparkSession, path, content, id_col)
