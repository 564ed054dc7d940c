"""The second stage of a clip: shots labelled by what is seen in them, the base cut with its fallbacks, and a second detection.

Times are nominal here: a clip of ``total`` frames at an average rate ``fps``
lasts total / fps seconds, and a time falls on the frame int(time * fps), at
most the last one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlab.functions.text import nominal_frame
from cutlab.operators import decode
from cutlab.sources.shared import keep


@dataclass(frozen=True)
class Options:
    """Thresholds and rates of a run; ``soft`` and ``second`` switch the fallbacks."""

    threshold: float = 0.35
    samples: int = 3
    soft: bool = True
    soft_rate: float = 4.0
    inner_rate: float = 6.0
    high: float = 0.45
    least_shot: float = 0.8
    most_back: float = 2.5
    least_back: float = 0.4
    second: bool = True


def sample_spans(spans: DataFrame, n: Column) -> DataFrame:
    """Spans (clip, a, b, ...) with k and at: the centres of ``n`` equal bins of [a, b]."""
    rows = spans.withColumn("bins", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    return rows.withColumn("at", F.col("a") + (F.col("b") - F.col("a")) * (F.col("k") + 0.5) / F.col("bins")).drop("bins")


def scored(samples: DataFrame, clips: DataFrame, scores: DataFrame) -> DataFrame:
    """Samples (clip, at, ...) with sim: the score (clip, idx, sim) of the frame they fall on, 0 where it has none.

    An equi-join on clip and frame, which reads only the scores of frames asked for.
    """
    at = samples.join(clips.select("clip", "fps", "total"), "clip").withColumn("idx", nominal_frame(F.col("at"), F.col("fps"), F.col("total")))
    own = at.join(scores.select("clip", "idx", F.col("sim").alias("sim_")), ["clip", "idx"], "left")
    return own.withColumn("sim", F.greatest(F.lit(0.0), F.nanvl(F.coalesce("sim_", F.lit(0.0)), F.lit(0.0)))).drop("fps", "total", "idx", "sim_")


def bins(length: Column, rate: float, least: int) -> Column:
    return F.greatest(F.lit(least), (length * rate).cast("int"))


def label_shots(shots: DataFrame, clips: DataFrame, scores: DataFrame, samples: int = 3) -> DataFrame:
    """Shots (clip, i, start, end) with sim: the median score at ``samples`` times spread evenly over each."""
    spans = shots.select("clip", "i", F.col("start").alias("a"), F.col("end").alias("b"))
    sims = scored(sample_spans(spans, F.lit(samples)), clips, scores).groupBy("clip", "i").agg(F.median("sim").alias("sim"))
    return shots.join(sims, ["clip", "i"])


def label_and_pick(shots: DataFrame, clips: DataFrame, scores: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(shots with sim, decisions (clip, n, cut, method)).

    Where the pick finds no cut, the whole clip is scanned for a gradual one;
    where it finds one, the shot before it is, if it is long enough, and a
    change there counts if it is neither next to the cut nor far from it. Each
    scan samples only the clips that need it. Clips without shots have no row.
    """
    shots = keep(label_shots(shots, clips, scores, options.samples))
    picked = decode.pick(shots.select("clip", "i", "start", "sim"), options.threshold)
    if not options.soft:
        return shots, picked.select("clip", "n", "cut", "method")
    picked = keep(picked)
    whole = picked.filter("cut is null").join(clips.select("clip", "fps", "total"), "clip")
    length = F.when(F.col("fps") != 0, F.col("total") / F.col("fps")).otherwise(0.0)
    whole = sample_spans(whole.select("clip", F.lit(0.0).alias("a"), length.alias("b")), bins(F.col("b"), options.soft_rate, 2))
    soft = decode.soft_cut(curve_of(scored(whole, clips, scores)), options.threshold)
    before = picked.filter("cut is not null").select("clip", (F.when(F.col("best") == 0, 1).otherwise(F.col("best")) - 1).alias("i"))
    inner = shots.join(before, ["clip", "i"]).select("clip", F.col("start").alias("a"), F.col("end").alias("b")).filter(F.col("b") - F.col("a") > options.least_shot)
    inner = sample_spans(inner, bins(F.col("b") - F.col("a"), options.inner_rate, 3))
    inner = decode.within_shot_cut(curve_of(scored(inner, clips, scores)), options.threshold, options.high)
    r = picked.join(soft.select("clip", F.col("cut").alias("soft")), "clip", "left").join(inner.select("clip", F.col("cut").alias("inner")), "clip", "left")
    near = (F.col("inner") >= F.col("cut") - options.most_back) & (F.col("inner") < F.col("cut") - options.least_back)
    cut = F.when(F.col("cut").isNull(), F.col("soft")).when(near, F.col("inner")).otherwise(F.col("cut"))
    method = F.when(F.col("cut").isNull() & F.col("soft").isNotNull(), "creator_to_meme_soft").when(near, "creator_to_meme_softcut").otherwise(F.col("method"))
    return shots, r.select("clip", "n", cut.alias("cut"), method.alias("method"))


def curve_of(samples: DataFrame) -> DataFrame:
    return samples.select("clip", F.col("k").alias("i"), F.col("at").alias("t"), "sim")


def relabel(shots: DataFrame, clips: DataFrame, scores: DataFrame, second: DataFrame | Callable[[DataFrame], DataFrame] | None = None, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(shots with sim and label, decisions (clip, n, cut, method)) of all clips.

    shots: clip, i (from 0), start, end, and what else belongs to a shot; clips:
    clip, fps, total; scores: clip, idx, sim. A clip of a single shot without a
    cut is detected a second time: ``second`` gives the shots of such clips, as
    a table or as a function of the clips left (clip), so that a model runs on
    those few alone. Where it finds several shots, they, their labels, and the
    cut and method that they lead to, fallbacks included, take the place of the
    first ones, whether there is a cut or not. Labels then follow the method.
    """
    shots, decided = label_and_pick(shots, clips, scores, options)
    if second is not None and options.second:
        decided = keep(decided)
        left = decided.filter("cut is null and n = 1").select("clip")
        again = second(left) if callable(second) else second.join(left, "clip", "left_semi")
        several = again.groupBy("clip").agg(F.count("*").alias("n")).filter("n > 1").select("clip")
        again = keep(again.join(several, "clip", "left_semi"))
        shots_2, decided_2 = label_and_pick(again, clips, scores, options)
        done = again.select("clip").distinct()
        shots = shots.join(done, "clip", "left_anti").unionByName(shots_2, allowMissingColumns=True)
        decided = decided.join(done, "clip", "left_anti").unionByName(decided_2)
    return decode.relabel(shots, decided, options.threshold), decided.select("clip", "n", F.round("cut", 3).alias("cut"), "method")


def documents(records: DataFrame, files: DataFrame, shots: DataFrame, decisions: DataFrame) -> DataFrame:
    """Records of the next stage: clip, transition_sec, method, num_shots, shots; those that could not be labelled as they were, with ``face_error``.

    A record with an error, without shots or without a file among ``files``
    (clip) is of that kind. Shots keep their own fields and get face_sim and
    label.
    """
    own = [c for c in ("start_frame", "end_frame") if c in shots.columns]
    fields = F.struct("i", F.col("start").alias("start_sec"), F.col("end").alias("end_sec"), *own, F.round("sim", 3).alias("face_sim"), "label")
    listed = shots.groupBy("clip").agg(F.array_sort(F.collect_list(fields)).alias("s"))
    rest = ["start_sec", "end_sec", *own, "face_sim", "label"]
    listed = listed.select("clip", F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in rest])).alias("shots"))
    good = decisions.select("clip", F.col("cut").alias("transition_sec"), "method", F.col("n").cast("int").alias("num_shots")).join(listed, "clip")
    usable = records.filter((F.coalesce(F.size("shots"), F.lit(0)) > 0) & F.col("error").isNull()).join(files.select("clip"), "clip", "left_semi").select("clip")
    bad = records.join(usable, "clip", "left_anti").withColumn("face_error", F.lit(True))
    kinds = {f.name: f.dataType for f in records.schema}
    good = good.join(usable, "clip", "left_semi").withColumn("shots", F.col("shots").cast(good.schema["shots"].dataType))
    if "shots" in kinds:  # missing fields of a shot are null
        elements = kinds["shots"].elementType.fieldNames()
        good = good.withColumn("shots", F.transform("shots", lambda x: F.struct(*[(x[c] if c in rest else F.lit(None)).cast(kinds["shots"].elementType[c].dataType).alias(c) for c in elements])))
    return good.unionByName(bad, allowMissingColumns=True)
