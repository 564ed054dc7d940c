"""Toxicity by compression distance: two trained zstandard dictionaries, window by window, with calibrated thresholds.

A toxic text is mostly ordinary text, and so is a dictionary that is trained on
all of it. Therefore the toxic dictionary is trained in rounds on the windows of
toxic texts that a dictionary of the other half of them compresses best against
the ordinary one; what is left is what toxic texts have in common and ordinary
ones do not have. Both sides of a comparison end with the ordinary dictionary,
next to the window; before it stands the toxic one on one side and nothing on the
other, so that lengths differ only by what the toxic dictionary alone holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlab.llm.common import text_or_empty

#: The model learns from at most this many labelled documents of either label, those with the smallest id hashes.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 3000, 5000
#: Characters of all sampled texts of a label that are learnt from, whole texts until they are used up.
SAMPLE_CHARS = 12_000_000
#: Longer texts are not learnt from (they are scored like any other).
SAMPLE_LONGEST = 40_000
#: Bytes of the ordinary dictionary, those that the toxic one may have (calibration picks), and of the segments that it is made of.
ORDINARY_BYTES, TOXIC_SIZES, TOXIC_SEGMENT = 110_000, (1024, 2048, 4096), 16
LEVEL = 12
#: Words in a window, and characters in one where blanks are further apart than that, as in Chinese or Japanese.
WINDOW, LONG_WORD = 8, 40
#: The share of toxic texts' windows that each round trains on, first by how badly the ordinary dictionary compresses them.
FIRST_SHARE, SHARES = 0.5, (0.3, 0.2, 0.2, 0.15, 0.12)
#: Gains in bytes over which windows are counted; calibration gives each count its weight.
GAINS = (1, 2, 3, 5)


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    #: Weights of the features of a text; None if a label has no text, and then every score is ``base``.
    weights: np.ndarray | None
    base: float = 0.0


def windows(text: str) -> list[bytes]:
    """WINDOW lower-cased words each, with blanks around them; longer words than LONG_WORD are cut into windows of their own."""
    found: list[str] = []
    held: list[str] = []
    for word in text.lower().split():
        if held and (len(word) > LONG_WORD or len(held) == WINDOW):
            found.append(" ".join(held))
            held = []
        if len(word) > LONG_WORD:
            found.extend(word[i : i + LONG_WORD] for i in range(0, len(word), LONG_WORD))
        else:
            held.append(word)
    if held:
        found.append(" ".join(held))
    return [f" {w} ".encode("utf-8", "replace") for w in found]


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary by zstandard's trainer; the last samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, d=8, k=segment, split_point=1.0, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(*contents: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(b"".join(contents) or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def _lengths(compressor: zstandard.ZstdCompressor, samples: list[bytes]) -> np.ndarray:
    return np.array([len(compressor.compress(s)) for s in samples], float)


class Scorer:
    """By how many bytes the toxic side compresses each window of a text better than the ordinary side."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.ordinary, self.toxic = _compressor(b"\0" * len(toxic), ordinary), _compressor(toxic, ordinary)

    def of(self, samples: list[bytes]) -> np.ndarray:
        return _lengths(self.ordinary, samples) - _lengths(self.toxic, samples)

    def gains(self, text: str) -> np.ndarray:
        return self.of(windows(text))


@lru_cache(maxsize=1)
def _scorer(ordinary: bytes, toxic: bytes) -> Scorer:
    """Kept by a worker from task to task."""
    return Scorer(ordinary, toxic)


def _features(gains: np.ndarray) -> np.ndarray:
    n, top = len(gains), np.sort(gains)[-3:]
    counts = [float((gains >= g).sum()) for g in GAINS]
    shares = [10 * c / n if n else 0.0 for c in counts[:-1]]
    return np.array([1.0, *map(math.log1p, counts), *shares, gains.mean() if n else 0.0, top[-1] / 5 if n else 0.0, top.sum() / 15, math.log1p(n) / 5])


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _loss(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def _best(samples: list[bytes], by: np.ndarray, share: float) -> list[bytes]:
    return [samples[i] for i in by.argsort(kind="stable")[::-1][: max(1, int(share * len(samples)))]]


def _toxic_dictionary(halves: list[list[bytes]], base: bytes, size: int) -> bytes:
    """Trained in rounds: each half trains on its windows that the other half's dictionary compresses best against the ordinary one."""
    blank = b"\0" * size
    plain = _compressor(blank, base)
    before = [_lengths(plain, h) for h in halves]
    chosen = [_best(h, n / np.array([len(w) for w in h]), FIRST_SHARE) for h, n in zip(halves, before)]
    for share in SHARES:
        other = [_compressor(_trained(c, size, TOXIC_SEGMENT).rjust(size, b"\0"), base) for c in chosen[::-1]]
        chosen = [_best(h, n - _lengths(o, h), share) for h, n, o in zip(halves, before, other)]
    return _trained(chosen[0] + chosen[1], size, TOXIC_SEGMENT).rjust(size, b"\0")


def learn(toxic: list[str], ordinary: list[str]) -> Model:
    """Trains both dictionaries on three quarters of the texts and calibrates on the rest.

    The toxic dictionary has the size with the least loss on those. Where a
    label has no text to train or to calibrate on, every score is 0.
    """
    parts = lambda texts: ([t for i, t in enumerate(texts) if i % 4], [t for i, t in enumerate(texts) if i % 4 == 0])
    (toxic_fit, toxic_rest), (ordinary_fit, ordinary_rest) = parts(toxic), parts(ordinary)
    halves = [[w for t in toxic_fit[h::2] for w in windows(t)] for h in (0, 1)]
    if not all(halves) or not ordinary_fit or not ordinary_rest or not toxic_rest:
        return Model(b"", b"", None)
    long = [b"".join(w[i : i + 4]) for t in ordinary_fit for w in [windows(t)] for i in range(0, len(w), 4)]
    base = _trained(long, ORDINARY_BYTES, 200)
    texts = [windows(t) for t in toxic_rest + ordinary_rest]
    y = np.array([1.0] * len(toxic_rest) + [0.0] * len(ordinary_rest))
    best = None
    for size in TOXIC_SIZES:
        bad = _toxic_dictionary(halves, base, size)
        scorer = Scorer(base, bad)
        x = np.array([_features(scorer.of(w)) for w in texts])
        w = _logistic(x, y)
        loss = _loss(w, x, y)
        if best is None or loss < best[0]:
            best = (loss, Model(base, bad, w))
    return best[1]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from a bounded sample of the labelled documents.

    Per label the ids with the smallest hashes are drawn, at most SAMPLE_TOXIC
    and SAMPLE_ORDINARY; those few ids are broadcast, so texts are not shuffled.
    """
    ids = None
    for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY)):
        own = labels.filter(F.col(label_col) == value).select(F.col(id_col).alias("id"), F.lit(value).alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(most)
        ids = own if ids is None else ids.unionByName(own)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(ids), "id")
    fair = rows.filter(F.length("text") <= SAMPLE_LONGEST).select("y", "id", "text")
    found: dict[int, list[str]] = {1: [], 0: []}
    used = {1: 0, 0: 0}
    for r in fair.orderBy(F.xxhash64("id"), "id", "text").toLocalIterator():
        if used[r.y] + len(r.text) <= SAMPLE_CHARS:
            found[r.y].append(r.text)
            used[r.y] += len(r.text)
    return learn(found[1], found[0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for every row: the calibrated probability, and 1 where it is at least a half.

    Null and empty texts are scored like any other: no window counts, so they
    get the calibrated base score. Texts of any length are scored whole, with or
    without blanks. Repeated rows get the same score each, null
    ids stay, and an empty table gives no rows. One narrow stage; the model is
    broadcast, and the two dictionaries have a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = _scorer(m.ordinary, m.toxic)
        for batch in batches:
            if m.weights is None:
                p = np.full(batch.num_rows, m.base)
            else:
                x = np.array([_features(scorer.gains(t.as_py())) for t in batch.column("text")]).reshape(-1, len(m.weights))
                p = 1 / (1 + np.exp(-np.clip(x @ m.weights, -30, 30)))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)
