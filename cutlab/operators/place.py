"""Moving segment boundaries to where the change really is, and the driver that cuts a clip into segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlab.functions.text import bar, pattern
from cutlab.operators.decode import seed_index, viterbi_grid, viterbi_states
from cutlab.operators.scan import folded
from cutlab.operators.series import inside, interval_median, nearest, run_segments, runs
from cutlab.sources.shared import keep


@dataclass(frozen=True)
class Config:
    """Knobs of the segmentation; a sweep runs a grid of them."""

    threshold: float = 0.32
    penalty: float = 1.0
    snap: bool = True
    snap_window: float = 0.35
    refine: bool = True
    return_back: float = 0.8
    return_forward: float = 0.3
    fade_back: float = 0.3
    fade_forward: float = 0.5
    hard_step: float = 34.0


def fade_times(boundaries: DataFrame, luma: DataFrame, curve: DataFrame, threshold: float = 0.35, dark: float = 48.0, bright: float = 212.0, hard_step: float = 34.0, back: float = 0.3, forward: float = 0.5, long: bool = False) -> DataFrame:
    """(clip, b, fade): where a fade bottoms out (or tops out) around each boundary b, else null.

    Luma samples in [b - back, b + forward] count: at least three, none more than
    ``hard_step`` from its successor. Of those whose nearest score is below
    ``threshold`` the darkest gives the time if it is dark, else the brightest if
    it is bright; the first of equals.
    """
    near = nearest(luma.select("clip", "i", F.col("t").alias("at"), "luma"), curve.select("clip", F.col("i").alias("idx"), F.col("t").alias("pts")), long)
    scored = near.join(curve.select("clip", F.col("i").alias("idx"), "sim"), ["clip", "idx"], "left")
    spans = boundaries.select("clip", "b").distinct().withColumn("a", F.col("b") - back)
    ends = spans.select("clip", F.col("b").alias("at_"), "a", (F.col("b") + forward).alias("b"))
    c = scored.select("clip", F.col("at").alias("t"), F.col("i").alias("li"), "luma", "sim")
    w = inside(ends, c, closed=True, long=long).join(ends, ["clip", "a", "b"]).select("clip", F.col("at_").alias("b"), F.col("t").alias("lt"), "li", "luma", "sim")
    jump = F.abs(F.lead("luma").over(Window.partitionBy("clip", "b").orderBy("li")) - F.col("luma"))
    w = w.withColumn("jump", jump).withColumn("low", F.col("sim") < threshold)
    g = w.groupBy("clip", "b").agg(
        F.count("*").alias("n"), F.coalesce(F.max("jump"), F.lit(0.0)).alias("jump"),
        F.min(F.when(F.col("low"), F.struct("luma", "li", "lt"))).alias("darkest"), F.max(F.when(F.col("low"), F.struct(F.col("luma"), (-F.col("li")).alias("li"), F.col("lt")))).alias("brightest"),
    )
    at = F.when(F.col("darkest.luma") <= dark, F.col("darkest.lt")).when(F.col("brightest.luma") >= bright, F.col("brightest.lt"))
    return g.select("clip", "b", F.when((F.col("n") >= 3) & (F.col("jump") <= hard_step), at).alias("fade"))


def snap_times(boundaries: DataFrame, cuts: DataFrame, window: float = 0.35, back: float = 0.8, forward: float = 0.3, long: bool = False) -> DataFrame:
    """(clip, b, near_cut, return_cut) for boundaries (clip, b) against hard cuts (clip, t).

    near_cut is the nearest cut at most ``window`` away; return_cut the nearest
    one in [b - back, b + forward]. Both are among the last cut before and the
    first one after, so one sort by clip finds them.
    """
    c = cuts.select("clip", F.col("t").alias("b"), F.col("t").alias("cut"), F.lit(0).alias("is_boundary"))
    both = boundaries.select("clip", "b", F.lit(None).cast("double").alias("cut"), F.lit(1).alias("is_boundary")).unionByName(c)
    both = folded(both, ["b", "is_boundary"], {"lo": ("last", "cut"), "hi": ("next", "cut")}, long)

    def nearer(lo_ok: Column, hi_ok: Column) -> Column:
        lo, hi = F.when(lo_ok, F.col("lo")), F.when(hi_ok, F.col("hi"))
        return F.when(lo.isNull() | (hi - F.col("b") < F.col("b") - lo), F.coalesce(hi, lo)).otherwise(lo)

    near = nearer(F.col("b") - F.col("lo") <= window, F.col("hi") - F.col("b") <= window)
    ret = nearer(F.col("lo") >= F.col("b") - back, F.col("hi") <= F.col("b") + forward)
    return both.filter("is_boundary = 1").select("clip", "b", near.alias("near_cut"), ret.alias("return_cut"))


def boundary_moves(boundaries: DataFrame, cuts: DataFrame, luma: DataFrame, curve: DataFrame, config: Config = Config()) -> DataFrame:
    """(clip, b, near_cut, return_cut, fade): where each boundary (clip, b) could go."""
    snapped = snap_times(boundaries, cuts, config.snap_window, config.return_back, config.return_forward)
    if not config.refine:
        return snapped.withColumn("fade", F.lit(None).cast("double"))
    return snapped.join(fade_times(boundaries, luma, curve, hard_step=config.hard_step, back=config.fade_back, forward=config.fade_forward), ["clip", "b"], "left")


def with_returns(segments: DataFrame) -> DataFrame:
    """Adds b, the start of each segment but the first, and returns: that it goes back to the first label."""
    prev = F.lag("state").over(Window.partitionBy("clip").orderBy("seg_idx"))
    s = segments.withColumn("prev", prev)
    return s.withColumn("b", F.when(F.col("prev").isNotNull(), F.col("start"))).withColumn("returns", (F.col("prev") == 1) & (F.col("state") == 0)).drop("prev")


def new_place(snap: Column, refine: Column) -> Column:
    """Where a boundary goes, null if it stays: on a return to a cut nearby, else to a fade, else to the nearest cut."""
    return F.coalesce(F.when(snap & F.col("returns"), F.col("return_cut")), F.when(refine, F.col("fade")), F.when(snap, F.col("near_cut")))


def moved_segments(segments: DataFrame, snap: bool = True, refine: bool = True, digits: int = 3) -> DataFrame:
    """Segments with b, returns, near_cut, return_cut and fade, with each interior boundary at its new place."""
    s = segments.withColumn("new", F.when(F.col("b").isNotNull(), F.round(new_place(F.lit(snap), F.lit(refine)), digits)))
    start, end = F.coalesce("new", "start"), F.coalesce(F.lead("new").over(Window.partitionBy("clip").orderBy("seg_idx")), F.col("end"))
    return s.select("clip", "seg_idx", start.alias("start"), end.alias("end"), "state", (end - start).alias("dur"), (end - start <= 0).alias("negative_dur"))


def place_boundaries(segments: DataFrame, cuts: DataFrame, luma: DataFrame, curve: DataFrame, config: Config = Config(), digits: int = 3) -> DataFrame:
    """Segments with interior boundaries moved: on a return to the first label a cut nearby, else a fade, else the nearest cut.

    Each boundary reads its own old place, so the order of moves does not
    matter. ``negative_dur`` marks segments whose boundaries crossed.
    """
    s = with_returns(segments)
    moves = boundary_moves(s.filter("b is not null").select("clip", "b").distinct(), cuts, luma, curve, config)
    return moved_segments(s.join(moves, ["clip", "b"], "left"), config.snap, config.refine, digits)


def first_cuts(clips: DataFrame) -> DataFrame:
    """Clips with ``first``: the curve's own first time where it names one, even a null, else the base cut; and an empty method as null."""
    first = F.when(F.col("has_first"), F.col("first_true")).otherwise(F.col("base_cut"))
    return clips.withColumn("first", first).withColumn("method", F.nullif("method", F.lit("")))


def undecoded(clips: DataFrame, seeds: DataFrame, digits: int = 3) -> DataFrame:
    """One segment for each clip without a first time, of the second label only if its method says so, and for each without samples (a seed), of the first label."""
    single = lambda df, state: df.select("clip", F.lit(0).alias("seg_idx"), F.lit(0.0).alias("start"), F.round("dur", digits).alias("end"), state.alias("state"))
    whole = single(clips.filter("first is null"), F.when(F.col("method") == "all_meme_no_creator", 1).otherwise(0))
    bare = single(clips.filter("first is not null").join(seeds.select("clip"), "clip", "left_anti"), F.lit(0))
    return whole.unionByName(bare)


def decode_clips(clips: DataFrame, curve: DataFrame, threshold: float, penalty: float, digits: int = 3) -> DataFrame:
    """Segments (clip, seg_idx, start, end, state) of clips (clip, dur, first, method), before boundaries are placed.

    Clips with a first time and samples are decoded from their seed on and cut
    into runs; the others are one segment (``undecoded``).
    """
    cut = clips.filter("first is not null")
    own = curve.join(cut.select("clip", "first"), "clip")
    seeds = seed_index(own.drop("first"), cut)
    return undecoded(clips, seeds, digits).unionByName(run_segments(runs(viterbi_states(own, threshold, penalty, seeds)), cut.select("clip", "dur"), digits))


def decode_grid(clips: DataFrame, curve: DataFrame, points: list[tuple[float, float]], digits: int = 3) -> DataFrame:
    """The same with g, under each (threshold, penalty) of ``points``, in one pass over the curve.

    A sample gives a row only where a state changes: there a segment begins,
    midway from the sample before it, and the one before it ends.
    """
    cut = clips.filter("first is not null")
    own = curve.join(cut.select("clip", "first"), "clip")
    seeds = seed_index(own.drop("first"), cut)
    names = [f"state_{g}" for g in range(len(points))]
    rows = viterbi_grid(own, points, seeds).withColumn("row", F.struct("t", *names))
    rows = folded(rows, ["i"], {"prev": ("lag", "row")})
    each = ", ".join(f"named_struct('g', {g}, 'state', {c}, 'old', prev.{c})" for g, c in enumerate(names))
    changes = F.expr(f"filter(array({each}), x -> prev is null or x.state <> x.old)")
    rows = rows.select("clip", "i", ((F.col("prev.t") + F.col("t")) / 2).alias("mid"), F.explode(changes).alias("x")).select("clip", "i", "mid", "x.g", "x.state")
    w = Window.partitionBy("clip", "g").orderBy("i")
    rows = rows.withColumn("seg_idx", F.row_number().over(w) - 1).withColumn("next", F.lead("mid").over(w)).join(cut.select("clip", "dur"), "clip")
    rows = rows.select("clip", "g", "seg_idx", F.round(F.coalesce("mid", F.lit(0.0)), digits).alias("start"), F.round(F.coalesce("next", "dur"), digits).alias("end"), "state")
    every = F.explode(F.sequence(F.lit(0), F.lit(len(points) - 1)))
    return rows.unionByName(undecoded(clips, seeds, digits).withColumn("g", every))


def segment_clips(clips: DataFrame, curve: DataFrame, cuts: DataFrame, luma: DataFrame, config: Config = Config(), digits: int = 3) -> tuple[DataFrame, DataFrame]:
    """(segments, decisions) of all clips.

    clips: clip, dur, has_first (the curve names a first time, possibly null),
    first_true, base_cut, method. Segments are those of ``decode_clips`` with
    boundaries placed; a decision's cut is where the second segment starts after
    that, null if there is one segment only. Decoded and placed segments are
    kept as tables, since every later part reads them.
    """
    clips = first_cuts(clips)
    decoded = keep(with_returns(decode_clips(clips, curve, config.threshold, config.penalty, digits)))
    moves = boundary_moves(decoded.filter("b is not null").select("clip", "b").distinct(), cuts, luma, curve, config)
    placed = keep(moved_segments(decoded.join(moves, ["clip", "b"], "left"), config.snap, config.refine, digits).withColumn("dur", F.round("dur", digits)))
    segments = interval_median(placed, curve, digits).withColumn("label", F.when(F.col("state") == 0, "person").otherwise("meme"))
    found = placed.groupBy("clip").agg(F.count_if(F.col("state") == 0).alias("people"), F.max(F.when(F.col("seg_idx") == 1, F.col("start"))).alias("cut"))
    method = F.when(F.col("first").isNull(), F.coalesce("method", F.lit(""))).when(F.col("people") > 1, "creator_returns").otherwise(F.coalesce("method", F.lit("creator_to_meme")))
    return segments, clips.join(found, "clip", "left").select("clip", "cut", method.alias("method"))


def segment_documents(segments: DataFrame) -> DataFrame:
    """One nested row a clip: n_segments, pattern and the ordered segments."""
    s = F.array_sort(F.collect_list(F.struct("seg_idx", "start", "end", "label", "dur", "face_sim")))
    d = segments.groupBy("clip").agg(s.alias("segments"))
    return d.select("clip", F.size("segments").alias("n_segments"), pattern(F.col("segments.label")).alias("pattern"), "segments")


def predicted_cuts(segments: DataFrame) -> DataFrame:
    """(clip, seg_idx, t): the starts of all segments but the first."""
    return segments.filter("seg_idx > 0").select("clip", "seg_idx", F.col("start").alias("t"))


def inspect(curve: DataFrame, marks: DataFrame, clip, reach: float = 0.6) -> DataFrame:
    """One clip's curve with a bar, and the marks (clip, t, kind) within ``reach`` of each sample."""
    m = marks.filter(F.col("clip") == clip).select(F.col("t").alias("mt"), "kind")
    c = curve.filter(F.col("clip") == clip)
    near = c.join(m, F.abs(F.col("mt") - F.col("t")) < reach, "left").groupBy("clip", "i", "t", "sim").agg(F.array_sort(F.collect_list("kind")).alias("marks"))
    return near.withColumn("bar", bar(F.col("sim")))
