"""Two-state decoding with a switch penalty, the best single split, and decisions built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlab.operators.scan import folded
from cutlab.operators.series import by_clip

PERSON, MEME = 0, 1
_FORCED = 1e9
#: Samples of a clip that are folded as one array.
BLOCK = 1024


def _leads(curve: DataFrame, points: list[tuple[float, float]], seeds: DataFrame | None, block: int) -> DataFrame:
    """Rows (clip, i, t, sim) with lead_0, lead_1, ...: for each (threshold, penalty), the lead of state 0 over state 1.

    All points are folded at once, so the curve is shuffled once for any number
    of them. What a block does to a lead is a shift between two limits, and so
    is what blocks in a row do; clips of several blocks give one such map a
    block, from which each block's first lead follows.
    """
    rows = curve.groupBy("clip", F.expr(f"cast(i div {block} as long)").alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "t", "sim"))).alias("s"))
    rows = rows.join(seeds.select("clip", "seed"), "clip", "left") if seeds is not None else rows.withColumn("seed", F.lit(0))
    rows = rows.select("clip", "block", "s", F.coalesce("seed", F.lit(0)).alias("seed"))
    each = range(len(points))
    # The folds are written as SQL: they are the same few terms once a point.
    gain = [f"2.0D * (x.sim - {float(t)!r}D)" for t, _ in points]
    between = lambda c, k: f"greatest(least({c}, {float(points[k][1])!r}D), -{float(points[k][1])!r}D)"
    moved = lambda c, k: f"if(x.i <= seed, {_FORCED}D, {between(c, k)} + {gain[k]})"
    fields = lambda of: "named_struct(" + ", ".join(f"'p{k}', {of(k)}" for k in each) + ")"
    infinite = lambda sign: fields(lambda k: f"double('{sign}Infinity')")
    forced, kind = fields(lambda k: f"{_FORCED}D"), "struct<" + ",".join(f"p{k}:double" for k in each) + ">"

    nothing = f"named_struct('shift', {fields(lambda k: '0.0D')}, 'low', {infinite('-')}, 'high', {infinite('')})"
    then = f"named_struct('shift', {fields(lambda k: f'm.shift.p{k} + {gain[k]}')}, 'low', {fields(lambda k: moved(f'm.low.p{k}', k))}, 'high', {fields(lambda k: moved(f'm.high.p{k}', k))})"
    maps = rows.select("clip", "block", F.expr(f"aggregate(s, {nothing}, (m, x) -> {then})").alias("map"))
    maps = maps.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("block", "map"))).alias("maps")).filter(F.size("maps") > 1)

    after = fields(lambda k: f"greatest(least(done.d.p{k} + x.map.shift.p{k}, x.map.high.p{k}), x.map.low.p{k})")
    none = f"named_struct('d', {forced}, 'all', cast(array() as array<struct<block:bigint,d:{kind}>>))"
    begin = f"named_struct('d', {after}, 'all', concat(done.all, array(named_struct('block', x.block, 'd', done.d))))"
    starts = maps.select("clip", F.expr(f"explode(aggregate(maps, {none}, (done, x) -> {begin}, done -> done.all))").alias("b")).select("clip", "b.block", F.col("b.d").alias("first"))
    rows = rows.join(starts, ["clip", "block"], "left").withColumn("first", F.coalesce("first", F.expr(forced)))

    step = fields(lambda k: moved(f"element_at(done, -1).p{k}", k))
    rows = rows.select("clip", "s", F.expr(f"slice(aggregate(s, array(first), (done, x) -> concat(done, array({step}))), 2, size(s))").alias("lead"))
    rows = rows.select("clip", F.explode(F.arrays_zip("s", "lead")).alias("x"))
    return rows.select("clip", "x.s.i", "x.s.t", "x.s.sim", *[F.col(f"x.lead.p{k}").alias(f"lead_{k}") for k in each])


def viterbi_grid(curve: DataFrame, points: list[tuple[float, float]], seeds: DataFrame | None = None, block: int = BLOCK, long: bool = False) -> DataFrame:
    """Rows (clip, i, t, sim) with state_0, state_1, ...: the states under each (threshold, penalty); see ``viterbi_states``."""
    rows = folded(_leads(curve, points, seeds, block), ["i"], {"next_i": ("lead", "i")}, long)
    last = F.col("next_i").isNull()

    def sure(k: int, penalty: float) -> Column:
        lead = F.col(f"lead_{k}")
        return F.when(lead > penalty, PERSON).when(lead < -penalty, MEME).when(last & (lead >= 0), PERSON).when(last, MEME).alias(f"sure_{k}")

    rows = rows.select("clip", "i", "t", "sim", *[sure(k, penalty) for k, (_, penalty) in enumerate(points)])
    rows = folded(rows, ["i"], {f"state_{k}": ("next", f"sure_{k}") for k in range(len(points))}, long)
    return rows.select("clip", "i", "t", "sim", *[f"state_{k}" for k in range(len(points))])


def viterbi_states(curve: DataFrame, threshold: float = 0.32, penalty: float = 1.0, seeds: DataFrame | None = None, block: int = BLOCK, long: bool = False) -> DataFrame:
    """Adds state: 0 where the curve is above the threshold, 1 below, with ``penalty`` for each switch.

    All samples up to the clip's seed (default 0) are state 0; ties favour
    staying and, at the end, state 0. With D the lead of state 0 over state 1,
    D becomes clamp(D, -penalty, penalty) + 2 (sim - threshold) from sample to
    sample, and a state is the first certain one from there on: 0 where D is
    above the penalty, 1 where it is below minus the penalty, at the end by sign.

    A clip of any length is folded in blocks of ``block`` positions, side by
    side. ``long`` spreads what looks ahead over tasks too (see ``scan``).
    """
    return viterbi_grid(curve, [(threshold, penalty)], seeds, block, long).withColumnRenamed("state_0", "state")


def best_split(rows: DataFrame, flag: str = "flag", long: bool = False) -> DataFrame:
    """(clip, n, best): the index 0..n with the most true flags before it and false ones after it, the first of equals."""
    value = F.when(F.col(flag), 1).otherwise(-1)
    rows = rows.select("clip", "i", value.alias("gain"), F.lit(1).alias("one"))
    rows = folded(rows, ["i"], {"sum": ("sum", "gain"), "pos": ("sum", "one")}, long)
    top = rows.groupBy("clip").agg(F.count("*").alias("n"), F.max(F.struct("sum", (-F.col("pos")).alias("minus"))).alias("top"))
    return top.select("clip", "n", F.when(F.col("top.sum") <= 0, 0).otherwise(-F.col("top.minus")).cast("int").alias("best"))


def pick(shots: DataFrame, threshold: float = 0.35, evidence_floor: float = 0.15) -> DataFrame:
    """(clip, n, best, cut, method) from labelled shots (clip, i, start, sim): where one label gives way to the other, if it does."""
    split = best_split(shots.withColumn("flag", F.col("sim") >= threshold)).join(shots.groupBy("clip").agg(F.max("sim").alias("top")), "clip")
    at = F.when(F.col("best") == 0, 1).otherwise(F.col("best"))
    r = split.withColumn("i", at).join(shots.select("clip", "i", F.col("start").alias("start_")), ["clip", "i"], "left")
    bare, one = F.col("top") < evidence_floor, F.col("n") == 1
    prior = (F.col("best") == 0) & ~bare & ~one
    cut = F.when(one | (F.col("best") == F.col("n")), F.lit(None)).when(prior | (F.col("best") > 0), F.col("start_"))
    method = (
        F.when(one & bare, "all_meme_no_creator").when(one, "single_shot_creator").when(F.col("best") == F.col("n"), "all_creator_no_transition").when((F.col("best") == 0) & bare, "all_meme_no_creator")
        .when(prior, "creator_to_meme_prior").otherwise("creator_to_meme")
    )
    return r.select("clip", "n", "best", cut.cast("double").alias("cut"), method.alias("method"))


def relabel(shots: DataFrame, picked: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Shots with the labels that the method of their clip implies."""
    r = shots.join(picked.select("clip", "cut", "method"), "clip")
    person = (
        F.when(F.col("method") == "creator_to_meme_prior", F.col("start") < F.col("cut") - 1e-6)
        .when(F.col("method").isin("single_shot_creator", "all_creator_no_transition"), True)
        .otherwise(F.col("sim") >= threshold)
    )
    return r.select(*shots.columns, F.when(person, "person").otherwise("meme").alias("label"))


def _windows(rows: DataFrame) -> DataFrame:
    """Adds pos (0-based), m (samples) and lead (the length of the leading window)."""
    rows = rows.withColumn("pos", F.row_number().over(by_clip().orderBy("i")) - 1).withColumn("m", F.count("*").over(by_clip()))
    return rows.withColumn("lead", F.greatest(F.lit(2), F.expr("m div 5").cast("int")))


def soft_cut(curve: DataFrame, threshold: float = 0.35, presence: float = 0.7, least_tail: float = 1.0, absence: float = 0.8, digits: int = 3) -> DataFrame:
    """(clip, cut): a gradual change over the whole clip; null unless the start is present, the tail long and absent enough."""
    rows = _windows(curve.withColumn("flag", F.col("sim") >= threshold))
    rows = rows.join(best_split(rows).select("clip", "best"), "clip")
    tail = F.col("pos") >= F.col("best")
    g = rows.groupBy("clip").agg(
        F.max("m").alias("m"), F.max("lead").alias("lead"), F.max("best").alias("best"), F.max("t").alias("end"), F.max(F.when(F.col("pos") == F.col("best"), F.col("t"))).alias("at"),
        F.count_if((F.col("pos") < F.col("lead")) & F.col("flag")).alias("early"), F.avg(F.when(tail, (~F.col("flag")).cast("double"))).alias("absent"),
    )
    fine = (F.col("early") >= presence * F.col("lead")) & (F.col("best") > 0) & (F.col("best") < F.col("m")) & (F.col("end") - F.col("at") >= least_tail) & (F.col("absent") >= absence)
    return g.select("clip", F.when(fine, F.round("at", digits)).alias("cut"))


def within_shot_cut(curve: DataFrame, threshold: float = 0.35, high: float = 0.45, presence: float = 0.55, absence: float = 0.6, digits: int = 3) -> DataFrame:
    """(clip, cut): a change inside one shot, from clear presence to a tail that is mostly and by its median absent."""
    rows = _windows(curve.withColumn("flag", F.col("sim") >= high))
    rows = rows.join(best_split(rows).select("clip", "best"), "clip")
    tail = F.col("pos") >= F.col("best")
    g = rows.groupBy("clip").agg(
        F.max("m").alias("m"), F.max("best").alias("best"), F.max(F.when(F.col("pos") == F.col("best"), F.col("t"))).alias("at"), F.avg(F.when(F.col("pos") < F.col("lead"), F.col("sim"))).alias("early"),
        F.avg(F.when(tail, (~F.col("flag")).cast("double"))).alias("absent"), F.median(F.when(tail, F.col("sim"))).alias("middle"),
    )
    fine = (F.col("early") >= presence) & (F.col("best") > 0) & (F.col("best") < F.col("m")) & (F.col("absent") >= absence) & (F.col("middle") < threshold)
    return g.select("clip", F.when(fine, F.round("at", digits)).alias("cut"))


def seed_index(curve: DataFrame, firsts: DataFrame) -> DataFrame:
    """(clip, seed): the last position whose time is not after the clip's ``first``, 0 if there is none."""
    r = curve.join(firsts.select("clip", "first"), "clip")
    return r.groupBy("clip").agg(F.coalesce(F.max(F.when(F.col("t") <= F.col("first"), F.col("i"))), F.lit(0)).alias("seed"))
