"""Byte-pair encoding by merge ranks, and decoding, over whole texts.

The vocabulary file is a public tokenizer in the JSON format of the tokenizers
library: lower-casing normaliser, words without white space, byte-level symbols
and an end-of-word suffix. Its path is a parameter; every Python worker loads it
once. Only ids that fit the vocabulary are made, so encoding is a pure function
of a text, and a lost task can run again anywhere.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cutlab.llm.common import text_or_empty

#: Words that a worker remembers in each of two generations.
CACHE_WORDS = 100_000
#: Characters that Python splits on but that Unicode does not call white space.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: What the library calls white space.
_WHITE_CLASS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = regex.compile(f"[{_WHITE_CLASS}]+")


class Remembered(dict):
    """word -> value, computed on first use; holds two generations so that it stays bounded and keeps what is in use."""

    def __init__(self, compute: Callable[[str], bytes], most: int = CACHE_WORDS) -> None:
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, word: str) -> bytes:
        value = self.old.pop(word, None)
        if value is None:
            value = self.compute(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says, and how a text falls into pieces before the merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: dict[int, str] = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.size = max(self.strings) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {self.ids[a] * self.size + self.ids[b]: k for k, (a, b) in enumerate(pairs)}
        self.merged = [self.ids[a + b] for a, b in pairs]
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", f"[^{_WHITE_CLASS}"))
        self.find_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.symbols = byte_symbols()
        self.path = path

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def pieces(self, word: str) -> list[str]:
        """The byte-level pieces of a word without white space.

        Python and the library may go by different versions of Unicode. Words
        with a character that is not assigned in Python's are normalised and cut
        by the library itself.
        """
        if word.isascii() and word.isprintable():
            return self.split.findall(word.lower())
        if any(unicodedata.category(c) in ("Cn", "Co") for c in word):
            return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))]
        low = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        return ["".join([self.symbols[b] for b in piece.encode("utf-8")]) for piece in self.split.findall(low)]

    def merge(self, piece: str) -> list[int]:
        """Ids of a piece: pops the lowest merge rank from a heap, joins two neighbours of a doubly linked list, skips stale entries."""
        ids = self.ids
        symbol = [i for c in piece[:-1] if (i := ids.get(c)) is not None]
        last = ids.get(piece[-1] + self.suffix)
        if last is not None:
            symbol.append(last)
        n = len(symbol)
        if n < 2:
            return symbol
        size, rank = self.size, self.rank.get
        heap = [r * n + i for i in range(n - 1) if (r := rank(symbol[i] * size + symbol[i + 1])) is not None]
        if not heap:
            return symbol
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push, merged = heapq.heappop, heapq.heappush, self.merged
        while heap:
            r, i = divmod(pop(heap), n)
            j = after[i]
            if symbol[i] < 0 or j >= n or rank(symbol[i] * size + symbol[j]) != r:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank(symbol[i] * size + symbol[k])) is not None:
                    push(heap, q * n + i)
            if (p := before[i]) >= 0 and (q := rank(symbol[p] * size + symbol[i])) is not None:
                push(heap, q * n + p)
        return [s for s in symbol if s >= 0]


class Encoder:
    """Whole texts to ids as little-endian unsigned 32-bit integers; words seen before come from a bounded memory."""

    def __init__(self, vocabulary: Vocabulary, merge: Callable[[str], list[int]] | None = None) -> None:
        self.vocabulary, merge = vocabulary, merge or vocabulary.merge
        self.piece = Remembered(lambda p: np.array(merge(p), "<u4").tobytes())
        self.word = Remembered(lambda w: b"".join([self.piece[p] for p in vocabulary.pieces(w)]))

    def plain(self, text: str) -> bytes:
        words = _WHITE.split(text) if any(c in text for c in _SEPARATORS) else text.split()
        return b"".join(map(self.word.__getitem__, words))

    def encode(self, text: str) -> bytes:
        v = self.vocabulary
        if v.find_special is None or not any(s in text for s in v.special):
            return self.plain(text)
        parts, at = [], 0
        for m in v.find_special.finditer(text):
            parts += [self.plain(text[at : m.start()]), np.uint32(v.special[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*parts, self.plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, one after the other; the file names no decoder, so a blank stands between two."""
        strings = self.vocabulary.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(Vocabulary(path))


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", content: bool = True) -> DataFrame:
    """Encodes and decodes every text.

    Returns (id, n_tokens, ids_sha256, decoded_sha256) and, with ``content``,
    ids array<int> and decoded string. A null text counts as empty: no ids, an
    empty decoded string. Repeated rows and ids give a row each; other columns
    are left out. No rows give no rows. One narrow stage: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            n, ids_sha, decoded_sha, id_lists, decoded = [], [], [], [], []
            for text in batch.column("text"):
                ids = enc.encode(text.as_py())
                back = enc.decode(ids)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                if content:
                    id_lists.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    decoded.append(back)
            columns = {"id": batch.column("id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())}
            if content:
                columns |= {"ids": pa.array(id_lists, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * content
    out = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
