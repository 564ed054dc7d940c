"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlab.llm.common import WORD, stored, text_or_empty

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No document, and no source, is taken more often than this.
MOST = 3.0
#: Documents that one flight balances at once.
BLOCK = 4096
#: Probabilities nearer than this to 0 or 1 are settled.
EPSILON = 1e-9
#: Up to so many sources have their row sent to all tasks.
MOST_SHARED = 100_000


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, get the weights in turn and share
    the sum of all sizes; a target stops at ``most`` times its source's size and
    the excess is shared out again by weight. In closed form: a source is full
    if its ratio of limit to weight is below the level at which the others, by
    weight, take what is left. Works on one row a source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights))) + 1)
    s = by_source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    s = s.withColumn("ratio", F.col("limit") / F.col("weight"))
    ordered = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The level rises as long as the next source is full and falls after that, so the highest is the one that holds.
    s = s.withColumn("level", F.max("level").over(whole))
    return s.select("source", F.col("source_size").cast("long").alias("source_size"), F.least("limit", F.col("weight") * F.col("level")).alias("target"))


def _per_source(rows: DataFrame) -> DataFrame:
    """One row a source, stored; sent to all tasks only where sources are few, and joined by source beyond that."""
    rows = stored(rows)
    return F.broadcast(rows) if rows.limit(MOST_SHARED + 1).count() <= MOST_SHARED else rows


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase: moves probabilities through the null space of the two totals until at most two stay fractional.

    Three fractional units span one direction that keeps both the sum of the
    probabilities and the sum of probability times size; a step along it settles
    a unit. The sense of the steps is drawn once for the unit that has waited
    longest, with its own probability, so that a very large document is settled
    by the small ones after it and is not left to be rounded.
    """
    p = p.copy()
    draws = iter(rng.random(len(p) + 8).tolist())
    window: list[int] = []
    rising, drawn_for = True, -1
    for k in range(len(p)):
        if EPSILON < p[k] < 1 - EPSILON:
            window.append(k)
        else:
            p[k] = round(p[k])
        while len(window) == 3:
            a, b, c = window
            if a != drawn_for:
                rising, drawn_for = next(draws, 0.5) < p[a], a
            u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[i]) / d if d > 0 else -p[i] / d for i, d in zip(window, u) if d)
            down = min(p[i] / d if d > 0 else (p[i] - 1) / d for i, d in zip(window, u) if d)
            lead = u[0] or u[1]
            step = up if rising == (lead > 0) else -down
            for i, d in zip(window, u):
                p[i] = min(1.0, max(0.0, p[i] + step * d))
            settled = [i for i in window if not EPSILON < p[i] < 1 - EPSILON]
            for i in settled:
                p[i] = round(p[i])
            window = [i for i in window if i not in settled]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The landing phase for the few units that are left: the outcome whose totals come nearest to the expected ones."""
    free = [i for i in range(len(p)) if EPSILON < p[i] < 1 - EPSILON]
    out = np.round(p)
    best = min(itertools.product((0.0, 1.0), repeat=len(free)), key=lambda way: (abs(sum((w - p[i]) * size[i] for w, i in zip(way, free))), abs(sum(w - p[i] for w, i in zip(way, free))), way))
    out[free] = best
    return out


def _balanced(pdf: pd.DataFrame, round_: int, landing: bool) -> pd.DataFrame:
    # Large documents come first and the others in hash order: what stays open to the end, and is rounded, is then small.
    large = pdf["size"].where(pdf["size"] > 4 * pdf["size"].mean(), 0)
    pdf = pdf.assign(large=large).sort_values(["large", "order", "id", "size"], ascending=[False, True, True, True], na_position="first", kind="stable")
    pdf = pdf.drop(columns="large").reset_index(drop=True)
    name = f"{pdf['source'].iloc[0]}|{pdf['block'].iloc[0]}|{round_}"
    size = pdf["size"].to_numpy(float)
    p = fly(pdf["p"].to_numpy(float), size, np.random.default_rng(zlib.crc32(name.encode())))
    return pdf.assign(p=land(p, size) if landing else p)


def _flight(round_: int, landing: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: _balanced(pdf, round_, landing)


def mixed(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """Units (id, source, size, p, ...) with every p settled to 0 or 1, each source's sums of p and of p * size nearly kept.

    Units of a source fall into blocks by their hash; a flight leaves at most two
    fractional units a block, which form the next round's blocks, until a source
    has one block, which also lands. No task holds more than about ``block``
    units, and a billion units take three rounds. Seeds and orders come from ids
    and sources alone, so reruns agree.
    """
    fields = units.withColumn("order", F.xxhash64("id", "size")).withColumn("block", F.lit(0).cast("long"))
    schema = fields.schema
    done: list[DataFrame] = [fields.filter(f"p <= {EPSILON} or p >= 1 - {EPSILON}").withColumn("p", F.round("p"))]
    left = fields.filter(f"p > {EPSILON} and p < 1 - {EPSILON}")
    for round_ in itertools.count():
        counts = left.groupBy("source").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
        most = counts.agg(F.max("blocks")).first()[0]
        if most is None:
            break
        c = _per_source(counts.withColumnRenamed("source", "of"))
        dealt = left.join(c, left.source.eqNullSafe(c.of)).withColumn("block", F.pmod(F.xxhash64("order", F.lit(round_)), F.col("blocks"))).select(*schema.names)
        landing = most == 1
        flown = dealt.groupBy("source", "block").applyInPandas(_flight(round_, landing), schema)
        if landing:
            done.append(flown)
            break
        flown = stored(flown)
        done.append(flown.filter("p = 0 or p = 1"))
        left = flown.filter("p > 0 and p < 1")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("order", "block")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken.

    A source's documents are each taken target / source_size times: the whole
    part for all, one more for those that balanced sampling picks, so that the
    source's taken words and its number of copies come near what is expected.
    Null sources form one source, null texts have size 0 and are taken 0 times;
    a source without words has target 0. Rows that repeat an id count each, and
    null ids are drawn like any other. An empty table gives no rows; other
    columns do not matter. The targets are computed on one row a source.
    """
    sizes = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")))
    targets = _per_source(source_targets(sizes, weights, most).withColumnRenamed("source", "of"))
    rows = sizes.join(targets, sizes.source.eqNullSafe(F.col("of"))).drop("of")
    times = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("times", F.least(times, F.lit(most))).withColumn("whole", F.floor(F.col("times") + EPSILON)).withColumn("p", F.greatest(F.col("times") - F.col("whole"), F.lit(0.0)))
    copies = (F.col("whole") + F.col("p")).cast("int")
    out = mixed(rows.select("id", "source", "size", "source_size", "target", "whole", "p"))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
