"""Clips that are dealt out by ranges give what whole windows give; intervals are joined in linear time."""

import random
import statistics
import time

import pytest
from cutlab.operators import decode, place, series
from cutlab.operators.scan import folded
from pyspark.sql import functions as F


@pytest.fixture(scope="module", autouse=True)
def all_ranges(spark):
    """Small ranges stay apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


@pytest.fixture(scope="module")
def curve(spark):
    """One clip holds most of the rows; times tie."""
    rng = random.Random(6)
    rows = [(c, i, round(i * 0.37 // 1, 1) + (0.5 if i % 7 == 0 else 0.0), round(rng.random(), 3), rng.choice([None, i])) for c, n in (("hot", 3000), ("b", 40), ("c", 1), ("d", 2)) for i in range(n)]
    return spark.createDataFrame(rows, "clip string, i long, t double, sim double, v long").repartition(3).cache()


def same(df_of):
    short, long = (sorted(map(repr, df_of(x).collect())) for x in (False, True))
    assert short and short == long


def test_folds(curve):
    folds = {"a": ("sum", "v"), "b": ("last", "v"), "c": ("next", "v"), "d": ("lag", "v"), "e": ("lead", "v"), "f": ("lag", "row")}
    same(lambda long: folded(curve.withColumn("row", F.struct("i", "v")), ["i"], folds, long))
    rows = sorted(folded(curve, ["i"], folds | {"f": ("lag", "i")}, True).filter("clip = 'hot'").collect(), key=lambda r: r.i)
    total, last = 0, None
    for k, r in enumerate(rows):
        total, last = total + (r.v or 0), r.v if r.v is not None else last
        assert (r.b, r.d, r.e) == (last, rows[k - 1].v if k else None, rows[k + 1].v if k + 1 < len(rows) else None)
        assert (r.a or 0) == total and r.c == next((x.v for x in rows[k:] if x.v is not None), None)


def test_ranges_spread_a_clip(spark, curve):
    seen = curve.repartitionByRange("clip", "i").withColumn("p", F.spark_partition_id()).filter("clip = 'hot'").select("p").distinct().count()
    assert seen > 1


def test_operators_on_long_clips(curve):
    flagged = curve.withColumn("state", F.when(F.col("sim") >= 0.5, 0).when(F.col("sim") >= 0.2, 1))
    probes = curve.filter("i % 5 = 0").select("clip", F.col("i").alias("probe"), (F.col("t") + 0.2).alias("at"))
    frames = curve.filter("i % 3 = 0").select("clip", F.col("i").alias("idx"), F.col("t").alias("pts"))
    same(lambda long: series.nearest(probes, frames, long))
    same(lambda long: series.runs(flagged, long=long))
    same(lambda long: decode.best_split(curve.withColumn("flag", F.col("sim") >= 0.5), long=long))
    same(lambda long: decode.viterbi_states(curve, 0.5, 1.0, block=64, long=long))
    cuts = curve.filter("i % 11 = 0").select("clip", "t")
    same(lambda long: place.snap_times(probes.select("clip", F.col("at").alias("b")), cuts, long=long))
    spans = probes.select("clip", F.col("at").alias("start"), (F.col("at") + 9.0).alias("end"), "probe")
    same(lambda long: series.interval_median(spans, curve, long=long))


def test_spans_equal_brute_force(spark):
    """Overlapping, empty, reversed and repeated spans; ends on samples."""
    rng = random.Random(3)
    samples = [(c, float(rng.randrange(40)), round(rng.random(), 3)) for c in "ab" for _ in range(80)]
    spans = [(c, float(a), float(a + rng.randrange(-3, 12))) for c in "abz" for a in (rng.randrange(40) for _ in range(30))] * 2
    df, sp = spark.createDataFrame(samples, "clip string, t double, sim double"), spark.createDataFrame(spans, "clip string, a double, b double")
    for closed in (False, True):
        got = sorted(tuple(r) for r in series.inside(sp, df, closed).collect())
        assert got == sorted((c, a, b, t, s) for c, a, b in set(spans) for k, t, s in samples if k == c and a <= t and (t <= b if closed else t < b))
    seg = sp.select("clip", F.col("a").alias("start"), F.col("b").alias("end")).withColumn("n", F.lit(1))
    for r in series.interval_median(seg, df).collect():
        own = [s for k, t, s in samples if k == r.clip and r.start <= t < r.end]
        assert r.face_sim == pytest.approx(round(statistics.median(own), 3) if own else 0.0, abs=0.0011)
    assert series.interval_median(seg, df).count() == len(spans)


def test_many_spans_of_one_clip(spark):
    """Linear: 200,000 samples and 20,000 spans of one clip are 4,000,000,000 pairs by clip."""
    samples = spark.range(200_000).select(F.lit("x").alias("clip"), F.col("id").cast("double").alias("t"), (F.col("id") % 10).cast("double").alias("sim"))
    spans = spark.range(20_000).select(F.lit("x").alias("clip"), (F.col("id") * 10.0).alias("start"), (F.col("id") * 10.0 + 10.0).alias("end"))
    out = series.interval_median(spans, samples, long=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    began = time.time()
    assert out.agg(F.count("*"), F.min("face_sim"), F.max("face_sim")).first() == (20_000, 4.5, 4.5)
    assert time.time() - began < 120
