"""The curve cache: what later stages need of a clip, sampled once and kept by clip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlab.functions.text import short_id
from cutlab.operators.series import clip_duration, dense_curve, nearest

#: Tables of a cache: curves, luma curves, hard cuts, and clips.
TABLES = ("samples", "luma", "cuts", "clips")


def dump(records: DataFrame, frames: DataFrame, scores: DataFrame, luma: DataFrame, rate: float = 10.0, luma_rate: float = 15.0) -> dict[str, DataFrame]:
    """The tables of a cache, by name, all with clip.

    records: clip, transition_sec, method, shots; frames: clip, idx, pts;
    scores: clip, idx, sim; luma: clip, idx, mean. Clips without frames are left
    out. Shot starts but the first, and the first cut, move to the times of
    their nearest real frames.
    """
    durations = clip_duration(frames)
    known = records.join(durations, "clip")
    spans = known.select("clip", "dur")
    samples = dense_curve(spans, frames, scores.select("clip", "idx", F.col("sim").alias("v")), rate)
    grey = dense_curve(spans, frames, luma.select("clip", "idx", F.col("mean").alias("v")), luma_rate, 2).withColumnRenamed("sim", "luma")
    starts = known.select("clip", F.posexplode("shots.start_sec").alias("k", "at")).filter("k > 0").select("clip", "k", "at")
    first = known.filter("transition_sec is not null").select("clip", F.lit(0).alias("k"), F.col("transition_sec").alias("at"))
    near = nearest(starts.unionByName(first), frames).select("clip", "k", F.round("pts", 3).alias("t"))
    clips = known.select("clip", F.round("dur", 3).alias("dur"), F.coalesce("method", F.lit("")).alias("method"))
    clips = clips.join(near.filter("k = 0").select("clip", F.col("t").alias("first_true")), "clip", "left").withColumn("has_first", F.lit(True))
    return {"samples": samples, "luma": grey, "cuts": near.filter("k > 0").select("clip", "k", "t"), "clips": clips.select("clip", "dur", "has_first", "first_true", "method")}


def save(tables: dict[str, DataFrame], name: str, buckets: int = 64) -> None:
    """Saves a cache as tables ``<name>_<table>`` in buckets by clip: what groups, joins or orders them by clip needs no exchange."""
    for table, rows in tables.items():
        order = ["clip", *(c for c in ("i", "k") if c in rows.columns)]
        rows.repartition(buckets, "clip").write.mode("overwrite").bucketBy(buckets, "clip").sortBy(*order).saveAsTable(f"{name}_{table}")


def documents(tables: dict[str, DataFrame], rate: float = 10.0, luma_rate: float = 15.0) -> DataFrame:
    """One nested row a clip, as the curve document has them: (short, clip, dur, times, sims, ...); a null first time stands there."""

    def lists(table: str, order: str, **fields: str) -> DataFrame:
        s = F.array_sort(F.collect_list(F.struct(order, *fields.values())))
        return tables[table].groupBy("clip").agg(s.alias("s")).select("clip", *[F.col("s").getField(c).alias(name) for name, c in fields.items()])

    none = F.array().cast("array<double>")
    rows = tables["clips"].join(lists("samples", "i", times="t", sims="sim"), "clip", "left").join(lists("luma", "i", times_l="t", luma="luma"), "clip", "left").join(lists("cuts", "k", transnet_cuts="t"), "clip", "left")
    full = lambda c: F.coalesce(c, none).alias(c)
    return rows.select(
        short_id(F.col("clip")).alias("short"), "clip", "dur", F.lit(rate).alias("sample_fps"), full("times"), full("sims"), full("transnet_cuts"), F.lit(luma_rate).alias("luma_fps"), full("times_l"), full("luma"), "first_true", "method"
    )
