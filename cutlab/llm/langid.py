"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutlab.llm.common import drop_stored, stored

#: Predicted where a text is null or has no letter.
UNDETERMINED = "und"
#: Characters handled at once, so that a very long text needs no more memory than this.
WINDOW = 1 << 19
#: Languages that one model may know.
MOST_LANGUAGES = 200
_PRIMES = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: log P(bucket | language), one column a language.
    log_likelihood: np.ndarray
    log_prior: np.ndarray
    orders: tuple[int, ...]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter; 32 for all that is no letter."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            out[c] = ord(low) if len(low := s.lower()) == 1 else c
    return out


def _buckets(text: str, orders: tuple[int, ...], n_buckets: int) -> Iterator[np.ndarray]:
    """Hashed n-grams of the lower-cased letters, window by window; runs of other characters count as one blank."""
    table, longest = _letters(), max(orders)
    for at in range(0, len(text), WINDOW):
        raw = text[max(0, at - longest + 1) : at + WINDOW].encode("utf-32-le", "surrogatepass")
        c = table[np.frombuffer(raw, "<u4")]
        c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)]))
        c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
        if len(c) < 2:
            continue
        h = np.zeros(len(c), np.uint32)
        for n in range(1, longest + 1):
            k = len(c) - n + 1
            if k <= 0:
                break
            h = h[:k] * _PRIMES[0] + (c[n - 1 :] + np.uint32(n)) * _PRIMES[1]
            if n in orders:
                mixed = (h ^ (h >> np.uint32(15))) * _PRIMES[2]
                yield (mixed >> np.uint32(7)) & np.uint32(n_buckets - 1)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", orders: tuple[int, ...] = (1, 2, 3), n_buckets: int = 1 << 16, smoothing: float = 0.5) -> Model:
    """Counts n-grams of all labelled rows and turns them into log-probabilities.

    Tasks add up their own counts before the shuffle; the driver gets at most
    languages * n_buckets sums of 16 bytes, however many rows there are. More
    than MOST_LANGUAGES languages raise, since that table is kept by the driver
    and every worker. Rows with a null text or language are left out; repeated
    rows count each. With no row left, as from an empty table, the model knows
    no language.
    """
    assert n_buckets & (n_buckets - 1) == 0, "a power of two"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                own = sums.setdefault(lang, np.zeros(n_buckets + 1, np.int64))
                own[n_buckets] += 1
                for ids in _buckets(text, orders, n_buckets):
                    own[:n_buckets] += np.bincount(ids, minlength=n_buckets)
        for lang, own in sums.items():
            used = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": used.astype(np.int32), "n": own[used]})

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    sums = stored(rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    languages = tuple(sorted(r.lang for r in sums.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((n_buckets + 1, max(1, len(languages))))
    if languages:
        place = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int") - 1
        found = sums.select("bucket", place.alias("at"), "n").toArrow()
        counts[found["bucket"].to_numpy(), found["at"].to_numpy()] = found["n"].to_numpy()
    drop_stored(sums)
    grams, docs = counts[:n_buckets] + smoothing, counts[n_buckets] + 1
    return Model(languages, np.log(grams / grams.sum(axis=0)), np.log(docs / docs.sum()), orders)


def _score(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Adds the log-probabilities of each text's n-grams, for many texts at once."""
    n_buckets, found = len(model.log_likelihood), len(model.languages) > 0
    total = np.tile(model.log_prior, (len(texts), 1))
    pending: list[np.ndarray] = []
    owner: list[int] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        if pending:
            starts = np.concatenate(([0], np.cumsum([len(p) for p in pending])[:-1]))
            np.add.at(total, owner, np.add.reduceat(model.log_likelihood[np.concatenate(pending)], starts, axis=0))
        pending.clear()
        owner.clear()
        waiting = 0

    known = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        if not text or not found:
            continue
        for ids in _buckets(text, model.orders, n_buckets):
            known[i] = True
            pending.append(ids)
            owner.append(i)
            waiting += len(ids)
            if waiting > WINDOW:
                flush()
    flush()
    best = total.argmax(axis=1)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    score = p.max(axis=1) / p.sum(axis=1)
    return [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known)], [float(s) if k else 0.0 for s, k in zip(score, known)]


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (the posterior of lang_pred) to every row, replacing columns of these names.

    A null text, one without a letter, and any text under a model that knows no
    language get "und" and 0. Of languages with equal posteriors the first by name
    is predicted; repeated rows are predicted each, and no rows give no rows.
    Texts are read in windows, so a very long one needs no more memory than
    another. One narrow stage; the model is broadcast, and its size depends on languages * n_buckets alone.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = _score(batch.column(text_col).to_pylist(), shared.value)
            yield batch.append_column("lang_pred", pa.array(lang, pa.string())).append_column("score", pa.array(score, pa.float64()))

    rows = docs.select(*kept)
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)
