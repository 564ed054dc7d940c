"""Grid search: many configurations over all clips in one plan."""

from __future__ import annotations

import itertools
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlab.operators.match import greedy_match, totals
from cutlab.operators.place import Config, boundary_moves, decode_grid, first_cuts, new_place, with_returns
from cutlab.sources.shared import keep

THRESHOLDS, PENALTIES = (0.28, 0.30, 0.32, 0.35), (0.5, 1.0, 1.5, 2.0)


def sweep(
    spark: SparkSession, clips: DataFrame, curve: DataFrame, cuts: DataFrame, luma: DataFrame, truth: DataFrame, tolerance: float = 0.5, top: int = 15,
    thresholds: tuple[float, ...] = THRESHOLDS, penalties: tuple[float, ...] = PENALTIES, config: Config = Config(), digits: int = 3,
) -> DataFrame:
    """Scores of the clip driver under every threshold, penalty and with and without refining, best first.

    Best by clips wholly right, then precision plus recall, then grid position
    (refined before not). clips, curve, cuts and luma as in ``segment_clips``,
    truth (clip, truth array). All thresholds and penalties are decoded in one
    pass over the curve; where a boundary can move does not depend on them and is
    looked up once for all. ``top`` is how many rows a sweep reports.
    """
    points = [(float(t), float(p)) for t, p in itertools.product(thresholds, penalties)]
    decoded = decode_grid(first_cuts(clips).select("clip", "dur", "first", "method"), curve.select("clip", "i", "t", "sim"), points, digits)
    decoded = decoded.withColumn("own", F.col("clip")).withColumn("clip", F.struct("g", F.col("clip")))
    decoded = keep(with_returns(decoded).filter("b is not null").select(F.col("own").alias("clip"), "g", "seg_idx", "start", "b", "returns"))
    moves = boundary_moves(decoded.select("clip", "b").distinct(), cuts, luma, curve, replace(config, refine=True))
    place = lambda refine: F.coalesce(F.round(new_place(F.lit(config.snap), F.lit(refine)), digits), F.col("start"))
    placed = decoded.join(moves, ["clip", "b"], "left").select("clip", "g", F.struct("seg_idx", place(True).alias("t1"), place(False).alias("t0")).alias("s"))
    pred = placed.groupBy("clip", "g").agg(F.array_sort(F.collect_list("s")).alias("s"))
    every = F.explode(F.sequence(F.lit(0), F.lit(len(points) - 1)))  # a clip's truth once a point
    none = F.array().cast("array<double>")
    both = truth.select("clip", "truth", every.alias("g")).join(pred, ["clip", "g"], "left")
    both = both.select("g", "truth", F.posexplode(F.array(*[F.coalesce(F.col(f"s.{t}"), none) for t in ("t1", "t0")])).alias("k", "pred"))
    t = totals(greedy_match(both.select((F.col("g") * 2 + F.col("k")).alias("cfg"), "truth", "pred"), tolerance), "cfg")
    named = F.array(*[F.array(F.lit(t_), F.lit(p)) for t_, p in points])
    point = F.get(named, F.expr("cfg div 2").cast("int"))
    t = t.select("cfg", F.get(point, F.lit(0)).alias("threshold"), F.get(point, F.lit(1)).alias("penalty"), (F.col("cfg") % 2 == 0).alias("refine"), *[c for c in t.columns if c != "cfg"])
    return t.orderBy(F.desc("full"), F.desc(F.col("precision") + F.col("recall")), "cfg").limit(top)
