"""Nearest-time lookup, resampling, runs and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cutlab.operators.scan import folded
from cutlab.sources.shared import keep


def by_clip() -> WindowSpec:
    return Window.partitionBy("clip")


def nearest(probes: DataFrame, frames: DataFrame, long: bool = False) -> DataFrame:
    """Adds idx and pts of the frame nearest in time to each probe's ``at``; a tie goes to the earlier frame.

    One shuffle by clip: probes and frames are sorted together, and every probe
    looks at the last frame before it and the first one after it. ``long`` is
    for tables in which one clip may hold millions of rows (see ``scan``). A
    clip without frames gives nulls. Of frames at one time the one with the
    lowest idx counts.
    """
    f = frames.groupBy("clip", F.col("pts").alias("at")).agg(F.min("idx").alias("idx")).select("clip", "at", F.struct(F.col("at").alias("pts"), "idx").alias("_frame"), F.lit(0).alias("_probe"))
    both = probes.drop("idx", "pts").withColumn("_probe", F.lit(1))
    names = both.columns[:-1]
    both = both.unionByName(f, allowMissingColumns=True)
    both = folded(both, ["at", "_probe"], {"_before": ("last", "_frame"), "_after": ("next", "_frame")}, long)
    before, after = F.col("_before.pts"), F.col("_after.pts")
    earlier = after.isNull() | (before.isNotNull() & (F.col("at") - before <= after - F.col("at")))
    hit = F.when(earlier, F.col("_before")).otherwise(F.col("_after"))
    return both.filter("_probe = 1").withColumn("_hit", hit).select(*names, F.col("_hit.idx").alias("idx"), F.col("_hit.pts").alias("pts"))


def nearest_in(times: Column, at: Column) -> Column:
    """The value of a short sorted array nearest to ``at``, the first one on ties; null for an empty array."""
    return F.array_min(F.transform(times, lambda t, i: F.struct(F.abs(t - at).alias("d"), i.alias("i"), t.alias("t")))).getField("t")


def clip_duration(frames: DataFrame) -> DataFrame:
    """(clip, dur): the last time and the gap before it once more."""
    gap = F.col("pts") - F.lag("pts").over(by_clip().orderBy("pts"))
    rows = frames.withColumn("gap", gap)
    last = F.max(F.struct("pts", "gap"))
    return rows.groupBy("clip").agg(last.alias("l")).select("clip", (F.col("l.pts") + F.coalesce("l.gap", F.lit(0.0))).alias("dur"))


def sample_times(clips: DataFrame, rate: float, least: int = 2) -> DataFrame:
    """(clip, k, at): the centres of max(least, int(dur * rate)) equal bins."""
    n = F.greatest(F.lit(least), (F.col("dur") * rate).cast("int"))
    rows = clips.select("clip", "dur", n.alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select("clip", "k", (F.col("dur") * (F.col("k") + 0.5) / F.col("n")).alias("at"))


def uniform_samples(clips: DataFrame, frames: DataFrame, rate: float, least: int = 2) -> DataFrame:
    """(clip, k, at, idx, pts): the frame nearest to each bin's centre; frames can repeat."""
    return nearest(sample_times(clips, rate, least), frames)


def dense_curve(clips: DataFrame, frames: DataFrame, values: DataFrame, rate: float, digits: int = 4) -> DataFrame:
    """A curve sampled in real time: values (clip, idx, v) at the sampled frames, 0 where there is none."""
    s = uniform_samples(clips, frames, rate)
    v = s.join(values, ["clip", "idx"], "left")
    return v.select("clip", F.col("k").alias("i"), F.round("pts", 3).alias("t"), F.round(F.coalesce("v", F.lit(0.0)), digits).alias("sim"))


def true_clock(shots: DataFrame, frames: DataFrame, digits: int = 3) -> DataFrame:
    """Shots (clip, shot_idx, start, end) moved to the times of real frames, with start_frame and end_frame."""
    ends = shots.select("clip", "shot_idx", F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("start").alias("at")), F.struct(F.lit("end").alias("side"), F.col("end").alias("at")))).alias("e"))
    near = nearest(ends.select("clip", "shot_idx", "e.side", "e.at"), frames)
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    return near.groupBy("clip", "shot_idx").agg(
        F.round(side("start", "pts"), digits).alias("start"), F.round(side("end", "pts"), digits).alias("end"), side("start", "idx").alias("start_frame"), side("end", "idx").alias("end_frame")
    )


def runs(rows: DataFrame, value: str = "state", long: bool = False) -> DataFrame:
    """(clip, run, value, i0, i1, t0, t1, before, after): maximal stretches of equal values, and the times next to them.

    Nulls equal each other. One sort by clip; ``long`` as in ``nearest``.
    """
    rows = rows.select("clip", "i", "t", value).withColumn("_row", F.struct("i", "t", value))
    rows = folded(rows, ["i"], {"_prev": ("lag", "_row"), "_next": ("lead", "_row")}, long)
    new = F.when(F.col("_prev").isNotNull() & F.col(f"_prev.{value}").eqNullSafe(F.col(value)), 0).otherwise(1)
    rows = rows.select("clip", "i", "t", value, new.alias("_new"), F.col("_prev.t").alias("prev_t"), F.col("_next.t").alias("next_t"))
    rows = folded(rows, ["i"], {"run": ("sum", "_new")}, long).withColumn("run", F.col("run") - 1)
    first, last = F.min(F.struct("i", "t", "prev_t", value)), F.max(F.struct("i", "t", "next_t"))
    out = rows.groupBy("clip", "run").agg(first.alias("f"), last.alias("l"))
    return out.select("clip", "run", F.col(f"f.{value}").alias(value), F.col("f.i").alias("i0"), F.col("l.i").alias("i1"), F.col("f.t").alias("t0"), F.col("l.t").alias("t1"), F.col("f.prev_t").alias("before"), F.col("l.next_t").alias("after"))


def run_segments(run_rows: DataFrame, durations: DataFrame, digits: int | None = None) -> DataFrame:
    """Segments from runs: edges lie midway between neighbouring samples, and at 0 and the duration; rounded if ``digits`` is given."""
    place = lambda c: c if digits is None else F.round(c, digits)
    r = run_rows.join(durations, "clip")
    start = F.when(F.col("before").isNull(), F.lit(0.0)).otherwise((F.col("before") + F.col("t0")) / 2)
    end = F.when(F.col("after").isNull(), F.col("dur")).otherwise((F.col("t1") + F.col("after")) / 2)
    return r.select("clip", F.col("run").cast("int").alias("seg_idx"), place(start).alias("start"), place(end).alias("end"), "state")


def label_flips(shots: DataFrame) -> DataFrame:
    """Rows whose label differs from the one before; two missing labels are equal, a first row is no flip."""
    order = by_clip().orderBy("shot_idx")
    prev = F.struct(F.lag("shot_idx").over(order).alias("at"), F.lag("label").over(order).alias("label"))
    return shots.withColumn("prev", prev).filter(F.col("prev.at").isNotNull() & ~F.col("prev.label").eqNullSafe(F.col("label"))).drop("prev")


def label_counter(segments: DataFrame) -> DataFrame:
    """Adds k: the how manyeth segment of its label this is within the clip."""
    return segments.withColumn("k", F.row_number().over(Window.partitionBy("clip", "label").orderBy("seg_idx")))


def inside(spans: DataFrame, samples: DataFrame, closed: bool = False, long: bool = False) -> DataFrame:
    """(clip, a, b, and the samples' columns): every span (clip, a, b) with each sample of its clip that lies in it.

    Spans are [a, b), or [a, b] if ``closed``; they may overlap, and empty ones
    give no row. Ends and samples are sorted together, once: the number of
    samples before an end is a position, so a span is a range of positions, and
    its samples follow by an equi-join on (clip, position). Work is linear in
    samples, spans and pairs that come out; no key holds more rows than that.
    """
    spans = spans.select("clip", "a", "b").distinct()
    edge = lambda side, at, after: spans.select("clip", F.col(at).alias("at_"), F.lit(after).alias("after_"), F.lit(0).alias("is_"), F.struct("a", "b").alias("span_"), F.lit(side).alias("side_"))
    own = samples.select("clip", F.col("t").alias("at_"), F.lit(1).alias("after_"), F.lit(1).alias("is_"), F.struct(*[c for c in samples.columns if c != "clip"]).alias("row_"))
    both = own.unionByName(edge("a", "a", 0), allowMissingColumns=True).unionByName(edge("b", "b", 2 if closed else 0), allowMissingColumns=True)
    # Rows that tie are ends of other spans, or samples at one time: any order of them gives the same ranges.
    both = keep(folded(both.withColumn("tie_", F.monotonically_increasing_id()), ["at_", "after_", "tie_"], {"n_": ("sum", "is_")}, long))
    ranges = both.filter("is_ = 0").groupBy("clip", "span_").agg(F.max(F.when(F.col("side_") == "a", F.col("n_"))).alias("low"), F.max(F.when(F.col("side_") == "b", F.col("n_"))).alias("high"))
    ranges = ranges.filter("low < high").select("clip", "span_", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("n_"))
    rows = both.filter("is_ = 1").select("clip", "n_", "row_")
    return ranges.join(rows, ["clip", "n_"]).select("clip", "span_.a", "span_.b", "row_.*")


def interval_median(segments: DataFrame, curve: DataFrame, digits: int = 3, long: bool = False) -> DataFrame:
    """Segments with face_sim: the median sim of samples in [start, end), 0 if there is none."""
    pairs = inside(segments.select("clip", F.col("start").alias("a"), F.col("end").alias("b")), curve.select("clip", "t", "sim"), long=long)
    middle = pairs.groupBy("clip", F.col("a").alias("start"), F.col("b").alias("end")).agg(F.median("sim").alias("middle_"))
    return segments.join(middle, ["clip", "start", "end"], "left").select(*segments.columns, F.coalesce(F.round("middle_", digits), F.lit(0.0)).alias("face_sim"))
