"""The registered queries: every operator applied to the driver's tables, with the same query in DuckDB's SQL.

Events play the curves (clip = user, t in hours since the user's first event,
sim = value up to 100, over 100); purchases and signups play true and predicted
cuts; conversations play labelled shots; orders and line items frames and faces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutlab.functions import text as X
from cutlab.functions.vectors import doubles, dot, norm, normalise, similarity
from cutlab.operators.scan import folded
from cutlab.operators import decode, identity, match, place, relabel, report, series, truth
from cutlab.plans.sweep import PENALTIES, THRESHOLDS, sweep
from cutlab.sources import documents
from cutlab.sources.shared import keep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

HOUR = 3.6e9
THR, PEN = 0.32, 1.0

CURVE = """
ev AS (SELECT user_id AS clip, event_id, epoch_us(ts) AS us, value, event_type FROM events),
curve AS MATERIALIZED (SELECT clip, CAST(row_number() OVER (PARTITION BY clip ORDER BY us, event_id) - 1 AS BIGINT) AS i,
    (us - min(us) OVER (PARTITION BY clip)) / 3.6e9 AS t, least(value, 100.0::DOUBLE) / 100.0::DOUBLE AS sim, event_type FROM ev),
dur AS (SELECT clip, max(t) AS dur FROM curve GROUP BY clip)
"""


def viterbi_sql(thr: float = THR, pen: float = PEN) -> str:
    return f"""
lead_ AS (SELECT clip, i, t, sim, 1e9::DOUBLE AS d FROM curve WHERE i = 0
    UNION ALL SELECT c.clip, c.i, c.t, c.sim, greatest(least(l.d, {pen}::DOUBLE), -{pen}::DOUBLE) + 2.0::DOUBLE * (c.sim - {thr}::DOUBLE)
    FROM lead_ l JOIN curve c ON c.clip = l.clip AND c.i = l.i + 1),
sure_ AS (SELECT *, CASE WHEN d > {pen} THEN 0 WHEN d < -{pen} THEN 1 WHEN i = max(i) OVER (PARTITION BY clip) THEN CASE WHEN d >= 0 THEN 0 ELSE 1 END END AS sure FROM lead_),
st AS (SELECT clip, i, t, sim, CAST(first_value(sure IGNORE NULLS) OVER (PARTITION BY clip ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS state FROM sure_)
"""


RUNS = """
r1 AS (SELECT *, CASE WHEN lag(i) OVER w IS NOT NULL AND lag(state) OVER w IS NOT DISTINCT FROM state THEN 0 ELSE 1 END AS new_,
    lag(t) OVER w AS prev_t, lead(t) OVER w AS next_t FROM st WINDOW w AS (PARTITION BY clip ORDER BY i)),
r2 AS (SELECT *, CAST(sum(new_) OVER (PARTITION BY clip ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM r1),
runs AS (SELECT clip, run, any_value(state) AS state, min(i) AS i0, max(i) AS i1, min(t) AS t0, max(t) AS t1,
    first(prev_t ORDER BY i) AS before_, last(next_t ORDER BY i) AS after_ FROM r2 GROUP BY clip, run),
seg AS (SELECT r.clip, run AS seg_idx, CASE WHEN before_ IS NULL THEN 0.0::DOUBLE ELSE (before_ + t0) / 2 END AS start_,
    CASE WHEN after_ IS NULL THEN dur ELSE (t1 + after_) / 2 END AS end_, state FROM runs r JOIN dur USING (clip))
"""
SEGMENTS = f"WITH RECURSIVE {CURVE}, {viterbi_sql()}, {RUNS}"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, d: plain(f(spark, d))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    """Integers as long and floats as double, so that results compare by value."""
    kinds = {"int": "long", "smallint": "long", "tinyint": "long", "float": "double"}
    return df.select(*[F.col(f"`{c}`").cast(kinds[k]).alias(c) if k in kinds else F.col(f"`{c}`") for c, k in df.dtypes])


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def curve(spark: SparkSession, d: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    e = table(spark, d, "events").select(F.col("user_id").alias("clip"), "event_id", us.alias("us"), "value", "event_type")
    i = F.row_number().over(Window.partitionBy("clip").orderBy("us", "event_id")) - 1
    t = (F.col("us") - F.min("us").over(Window.partitionBy("clip"))) / F.lit(HOUR)
    return e.select("clip", i.alias("i"), t.alias("t"), (F.least("value", F.lit(100.0)) / 100.0).alias("sim"), "event_type")


def durations(c: DataFrame) -> DataFrame:
    return c.groupBy("clip").agg(F.max("t").alias("dur"))


def states(spark: SparkSession, d: str) -> DataFrame:
    return decode.viterbi_states(curve(spark, d), THR, PEN)


def segments(spark: SparkSession, d: str) -> DataFrame:
    return series.run_segments(series.runs(states(spark, d)), durations(curve(spark, d)))


def times_of(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return curve(spark, d).filter(F.col("event_type") == kind).select("clip", "t")


def cut_lists(spark: SparkSession, d: str) -> DataFrame:
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("event_type") == k, F.col("t"))))
    return curve(spark, d).groupBy("clip").agg(of("purchase").alias("truth"), of("signup").alias("pred"))


LISTS = """
lists AS (SELECT clip, coalesce(list(t ORDER BY t) FILTER (WHERE event_type = 'purchase'), []) AS truth,
    coalesce(list(t ORDER BY t) FILTER (WHERE event_type = 'signup'), []) AS pred FROM curve GROUP BY clip)
"""


def greedy_sql(source: str, tol: float, keys: str = "clip") -> str:
    qualified = ", ".join(f"g.{k.strip()}" for k in keys.split(","))
    return f"""
g AS (SELECT {keys}, truth, pred, 0 AS k, pred AS pool, CAST([] AS DOUBLE[]) AS errors FROM {source}
    UNION ALL SELECT {qualified}, truth, pred, k + 1,
        CASE WHEN m <= {tol} THEN list_concat(pool[:p - 1], pool[p + 1:]) ELSE pool END, CASE WHEN m <= {tol} THEN list_append(errors, m) ELSE errors END
    FROM (SELECT *, list_min([abs(x - truth[k + 1]) for x in pool]) AS m,
            list_position([abs(x - truth[k + 1]) for x in pool], list_min([abs(x - truth[k + 1]) for x in pool])) AS p FROM g WHERE k < len(truth)) g),
matched AS (SELECT {keys}, truth, pred, CAST(len(errors) AS BIGINT) AS tp, CAST(len(truth) - len(errors) AS BIGINT) AS missed, CAST(len(pool) AS BIGINT) AS extra,
    coalesce(list_sum(errors), 0.0) AS error_ FROM g WHERE k = len(truth))
"""


TOL = 4.0
VERDICT_SQL = "CASE WHEN len(truth) = 0 AND extra = 0 THEN 'correct_none' WHEN len(truth) = 0 THEN 'false_positive' WHEN tp = 0 THEN 'missed' WHEN missed = 0 AND extra = 0 THEN 'correct' ELSE 'partial' END"


@query(f"WITH {CURVE} SELECT clip, i, sim >= 0.35 AS flag FROM curve")
def threshold_flags(spark, d):
    return curve(spark, d).select("clip", "i", (F.col("sim") >= 0.35).alias("flag"))


@query("""SELECT doc_id, CASE WHEN name LIKE '%.mp4' THEN right(left(name, length(name) - 4), 12) ELSE name END AS short,
    CASE WHEN length(name) > 4 THEN right(left(name, length(name) - 4), 12) ELSE '' END AS short_always,
    CASE WHEN regexp_matches(name, '(?i)\\.mp4$') THEN regexp_replace(name, '(?i)\\.mp4$', '') ELSE regexp_replace(name, '^(.+)\\.[^.]*$', '\\1') END AS stem
    FROM (SELECT doc_id, concat('clip_', source, '_', lang, '_', doc_id, CASE doc_id % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MP4' ELSE '.mov' END) AS name FROM documents)""")
def short_id(spark, d):
    ext = F.when(F.col("doc_id") % 3 == 0, ".mp4").when(F.col("doc_id") % 3 == 1, ".MP4").otherwise(".mov")
    n = table(spark, d, "documents").select("doc_id", F.concat(F.lit("clip_"), "source", F.lit("_"), "lang", F.lit("_"), F.col("doc_id").cast("string"), ext).alias("name"))
    return n.select("doc_id", X.short_id(F.col("name")).alias("short"), X.short_id_always(F.col("name")).alias("short_always"), X.stem(F.col("name")).alias("stem"))


@query(f"""WITH {CURVE}, j AS (SELECT p.clip, p.i AS probe, f.i AS idx, f.t AS pts, row_number() OVER (PARTITION BY p.clip, p.i ORDER BY abs(f.t - p.t), f.t, f.i) AS rn
    FROM curve p JOIN curve f ON p.clip = f.clip AND p.event_type = 'purchase' AND f.event_type <> 'purchase')
    SELECT clip, probe, idx, round(pts, 6) AS pts FROM j WHERE rn = 1""")
def nearest_asof(spark, d):
    c = curve(spark, d)
    probes = c.filter("event_type = 'purchase'").select("clip", F.col("i").alias("probe"), F.col("t").alias("at"))
    frames = c.filter("event_type <> 'purchase'").select("clip", F.col("i").alias("idx"), F.col("t").alias("pts"))
    return series.nearest(probes, frames).filter("idx is not null").select("clip", "probe", "idx", F.round("pts", 6).alias("pts"))


@query(f"""WITH {CURVE}, n AS (SELECT clip, dur, greatest(2, CAST(trunc(dur * 0.05::DOUBLE) AS BIGINT)) AS n FROM dur),
    s AS (SELECT clip, k, dur * (k + 0.5::DOUBLE) / n AS at_ FROM n, unnest(range(n)) u(k)),
    j AS (SELECT s.clip, k, i AS idx, t AS pts, row_number() OVER (PARTITION BY s.clip, k ORDER BY abs(t - at_), t, i) AS rn FROM s JOIN curve c ON s.clip = c.clip)
    SELECT clip, k, idx, round(pts, 6) AS pts FROM j WHERE rn = 1""")
def uniform_sampling(spark, d):
    c = curve(spark, d)
    frames = c.select("clip", F.col("i").alias("idx"), F.col("t").alias("pts"))
    return series.uniform_samples(durations(c), frames, 0.05).select("clip", "k", "idx", F.round("pts", 6).alias("pts"))


@query(f"""WITH {CURVE}, f AS (SELECT clip, t, t - lag(t) OVER (PARTITION BY clip ORDER BY t) AS gap FROM curve)
    SELECT clip, round(max(t) + coalesce(arg_max(gap, t), 0), 6) AS dur FROM f GROUP BY clip""")
def clip_duration(spark, d):
    return series.clip_duration(curve(spark, d).select("clip", F.col("t").alias("pts"))).select("clip", F.round("dur", 6).alias("dur"))


@query(f"""WITH {CURVE}, b AS (SELECT clip, t AS b FROM curve WHERE event_type = 'signup'), c AS (SELECT clip, t FROM curve WHERE event_type = 'purchase'),
    n AS (SELECT b.clip, b, (SELECT c.t FROM c WHERE c.clip = b.clip AND abs(c.t - b) <= 6 ORDER BY abs(c.t - b), c.t LIMIT 1) AS near_cut,
        (SELECT c.t FROM c WHERE c.clip = b.clip AND c.t >= b - 24 AND c.t <= b + 9 ORDER BY abs(c.t - b), c.t LIMIT 1) AS return_cut FROM b)
    SELECT clip, round(b, 6) AS b, round(near_cut, 6) AS near_cut, round(return_cut, 6) AS return_cut FROM n""")
def range_window_snap(spark, d):
    b = times_of(spark, d, "signup").withColumnRenamed("t", "b")
    s = place.snap_times(b, times_of(spark, d, "purchase"), 6.0, 24.0, 9.0)
    return s.select("clip", F.round("b", 6).alias("b"), F.round("near_cut", 6).alias("near_cut"), F.round("return_cut", 6).alias("return_cut"))


@query(SEGMENTS + """ SELECT s.clip, s.seg_idx, coalesce(round(median(sim), 6), 0.0) AS face_sim FROM seg s
    LEFT JOIN curve c ON s.clip = c.clip AND c.t >= s.start_ AND c.t < s.end_ GROUP BY ALL""")
def interval_median(spark, d):
    return series.interval_median(segments(spark, d).select("clip", "seg_idx", "start", "end"), curve(spark, d), 6).select("clip", "seg_idx", "face_sim")


FACES = """f AS (SELECT l_orderkey AS frame, l_extendedprice AS area, l_discount - 0.05::DOUBLE AS sim,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount) - 1 AS face_no FROM lineitem)"""


@query(f"""WITH {FACES}, b AS (SELECT frame, max(sim) AS best FROM f GROUP BY frame), l AS (SELECT frame, face_no, row_number() OVER (PARTITION BY frame ORDER BY area DESC, face_no) AS rn FROM f)
    SELECT o_orderkey AS frame, round(greatest(0.0, coalesce(best, 0.0)), 6) AS best_sim, CAST(face_no AS BIGINT) AS largest
    FROM orders LEFT JOIN b ON o_orderkey = b.frame LEFT JOIN l ON o_orderkey = l.frame AND rn = 1""")
def best_per_group(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    f = identity.rank_within(f, ["frame"], "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount").select("frame", "face_no", F.col("l_extendedprice").alias("area"), (F.col("l_discount") - 0.05).alias("sim"))
    frames = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame"))
    largest = identity.largest_face(f, "frame").select("frame", F.col("face_no").alias("largest"))
    best = identity.best_similarity(frames, f, "frame").join(largest, "frame", "left")
    return best.select("frame", F.round("best_sim", 6).alias("best_sim"), "largest")


UNITS = """u AS (SELECT vec_id, label, [x / sqrt(list_sum([CAST(y AS DOUBLE) * y for y in embedding])) for x in CAST(embedding AS DOUBLE[])] AS unit FROM embeddings)"""


def _centroid_sql(passes: int, inlier: float) -> str:
    def mean(source: str, name: str) -> str:
        return f"""{name}_p AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(unit) AS x, unnest(range(1, len(unit) + 1)) AS pos FROM {source}) GROUP BY label, pos),
        {name}_m AS (SELECT label, list(x ORDER BY pos) AS m FROM {name}_p GROUP BY label),
        {name} AS (SELECT label, [x / sqrt(list_dot_product(m, m)) for x in m] AS c FROM {name}_m)"""

    parts = [UNITS, mean("u", "c0")]
    for k in range(passes):
        parts.append(f"""n{k} AS (SELECT u.* FROM u JOIN c{k} USING (label) WHERE list_dot_product(unit, c) >= {inlier}),
        e{k} AS (SELECT n{k}.* FROM n{k} JOIN (SELECT label FROM n{k} GROUP BY label HAVING count(*) >= 5) USING (label))""")
        parts.append(mean(f"e{k}", f"t{k}"))
        parts.append(f"c{k + 1} AS (SELECT a.label, coalesce(b.c, a.c) AS c FROM c{k} a LEFT JOIN t{k} b ON a.label = b.label)")
    return "WITH " + ",\n".join(parts)


@query(_centroid_sql(4, 0.1) + """ SELECT CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN list_dot_product(unit, c) >= 0.1 THEN 1 END) AS BIGINT) AS n_inliers,
    round(count(CASE WHEN list_dot_product(unit, c) >= 0.1 THEN 1 END) / count(*), 6) AS coverage, array_to_string([printf('%.6f', round(x, 6) + 0.0) for x in any_value(c)], ',') AS centroid FROM u JOIN c4 USING (label) GROUP BY label""")
def trimmed_centroid(spark, d):
    c = identity.trimmed_centroid(table(spark, d, "embeddings"), ["label"], inlier=0.1)
    return c.select("label", "n", "n_inliers", F.round("coverage", 6).alias("coverage"), numbers(F.col("centroid")).alias("centroid"))


def numbers(xs) -> Column:
    """All components as text, with six digits each."""
    return F.concat_ws(",", F.transform(xs, lambda x: F.format_string("%.6f", F.round(x, 6) + 0.0)))


ENROLLED = """fc AS (SELECT vec_id // 4 AS clip, vec_id % 2 AS idx, vec_id AS face_no, 10.0::DOUBLE + vec_id % 7 AS side, embedding FROM embeddings WHERE vec_id % 9 <> 0),
    op AS (SELECT clip, face_no, embedding FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY side * side DESC, face_no) AS rn FROM fc WHERE idx = CASE WHEN clip % 3 = 0 THEN 0 ELSE 1 END) WHERE rn = 1),
    u AS (SELECT 0 AS label, face_no AS vec_id, [x / sqrt(list_sum([CAST(y AS DOUBLE) * y for y in embedding])) for x in CAST(embedding AS DOUBLE[])] AS unit FROM op)"""


@query(_centroid_sql(4, 0.1).replace(UNITS, ENROLLED) + """, e AS (SELECT count(*) AS n, count(CASE WHEN list_dot_product(unit, c) >= 0.1 THEN 1 END) AS n_inliers, any_value(c) AS c FROM u, c4),
    s AS (SELECT clip, idx, max(list_dot_product([CAST(x AS DOUBLE) for x in embedding], c) / sqrt(list_sum([CAST(y AS DOUBLE) * y for y in embedding]))) AS sim FROM fc, e GROUP BY clip, idx)
    SELECT clip, idx, round(greatest(0.0, sim), 6) AS sim, n, n_inliers FROM s, e""")
def enrolled_scores(spark, d):
    """The identity of the largest faces one second into each clip, and how like it each frame's faces are; a clip is four vectors."""
    v = F.col("vec_id")
    rows = table(spark, d, "embeddings").withColumn("clip", F.expr("vec_id div 4"))
    side = (v % 7 + 10).cast("double")
    faces = rows.filter("vec_id % 9 <> 0").select("clip", (v % 2).alias("idx"), v.alias("face_no"), F.array(F.lit(0.0), F.lit(0.0), side, side).alias("bbox"), "embedding")
    # Of some clips the last frame lies before that second.
    clips = rows.select("clip").distinct().select("clip", F.lit(1.0).alias("fps"), F.when(F.col("clip") % 3 == 0, 1).otherwise(2).alias("total"))
    one = keep(identity.enrol(faces, clips, inlier=0.1))
    scores = identity.frame_scores(faces, one).crossJoin(F.broadcast(one.select("n", "n_inliers")))
    return scores.select("clip", "idx", F.round("sim", 6).alias("sim"), "n", "n_inliers")


@query(f"""WITH {UNITS}, p AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(unit) AS x, unnest(range(1, len(unit) + 1)) AS pos FROM u) GROUP BY label, pos),
    c AS (SELECT label, list(x ORDER BY pos) AS m FROM p GROUP BY label)
    SELECT vec_id, round(greatest(0.0, list_dot_product(unit, m) / sqrt(list_dot_product(m, m))), 6) AS sim FROM u JOIN c USING (label)""")
def cosine_to_centroid(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", normalise(doubles(F.col("embedding"))).alias("unit"))
    c = identity._mean_direction(e, ["label"])
    return e.join(c, "label").select("vec_id", F.round(similarity(F.col("unit"), F.col("centroid")), 6).alias("sim"))


@query("SELECT vec_id, round(sqrt(list_sum([CAST(x AS DOUBLE) * x for x in embedding])), 6) AS norm, array_to_string([printf('%.6f', round(x / sqrt(list_sum([CAST(y AS DOUBLE) * y for y in embedding])), 6) + 0.0) for x in CAST(embedding AS DOUBLE[])], ',') AS unit FROM embeddings")
def vector_norms(spark, d):
    v = doubles(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(v), 6).alias("norm"), numbers(normalise(v)).alias("unit"))


SPLIT = """sp0 AS (SELECT *, sum(CASE WHEN flag THEN 1 ELSE -1 END) OVER (PARTITION BY clip ORDER BY i ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY clip ORDER BY i) AS pos FROM fl),
    sp1 AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY s DESC, pos) AS rn, count(*) OVER (PARTITION BY clip) AS n FROM sp0),
    split AS (SELECT clip, n, CAST(CASE WHEN s <= 0 THEN 0 ELSE pos END AS BIGINT) AS best FROM sp1 WHERE rn = 1)"""


@query(f"WITH {CURVE}, fl AS (SELECT clip, i, sim >= 0.35 AS flag FROM curve), {SPLIT} SELECT clip, n, best FROM split")
def max_agreement_split(spark, d):
    return decode.best_split(curve(spark, d).withColumn("flag", F.col("sim") >= 0.35))


SHOTS = """sh AS (SELECT conv_id AS clip, CAST(turn AS BIGINT) AS i, CAST(turn AS DOUBLE) * 2.5::DOUBLE AS start_, (length(text) % 100) / 100.0::DOUBLE AS sim, role AS label FROM conversations)"""


def shots(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("clip"), F.col("turn").cast("int").alias("i"), (F.col("turn") * 2.5).cast("double").alias("start"), ((F.length("text") % 100) / 100.0).alias("sim"), F.col("role").alias("label"))


PICK = f"""{SHOTS}, fl AS (SELECT clip, i, sim >= 0.35 AS flag FROM sh), {SPLIT}, top AS (SELECT clip, max(sim) AS top FROM sh GROUP BY clip),
    picked AS (SELECT clip, n, best,
        CASE WHEN n = 1 OR best = n THEN NULL WHEN best = 0 AND top < 0.15 THEN NULL ELSE (SELECT start_ FROM sh WHERE sh.clip = split.clip AND sh.i = CASE WHEN best = 0 THEN 1 ELSE best END) END AS cut,
        CASE WHEN n = 1 AND top < 0.15 THEN 'all_meme_no_creator' WHEN n = 1 THEN 'single_shot_creator' WHEN best = n THEN 'all_creator_no_transition'
             WHEN best = 0 AND top < 0.15 THEN 'all_meme_no_creator' WHEN best = 0 THEN 'creator_to_meme_prior' ELSE 'creator_to_meme' END AS method
        FROM split JOIN top USING (clip))"""


@query(f"WITH {PICK} SELECT clip, n, best, cut, method FROM picked")
def pick_decision(spark, d):
    return decode.pick(shots(spark, d))


@query(f"""WITH {PICK} SELECT sh.clip, sh.i, CASE WHEN CASE WHEN method = 'creator_to_meme_prior' THEN start_ < cut - 1e-6
    WHEN method IN ('single_shot_creator', 'all_creator_no_transition') THEN true ELSE sim >= 0.35 END THEN 'person' ELSE 'meme' END AS new_label FROM sh JOIN picked USING (clip)""")
def label_by_method(spark, d):
    s = shots(spark, d).drop("label")
    return decode.relabel(s, decode.pick(s)).select("clip", "i", F.col("label").alias("new_label"))


def _lead_sql(threshold: float) -> str:
    return f"fl AS (SELECT clip, i, t, sim, sim >= {threshold} AS flag FROM curve), {SPLIT}, ld AS (SELECT f.*, row_number() OVER (PARTITION BY f.clip ORDER BY i) - 1 AS pos, n AS m, greatest(2, n // 5) AS lead, best FROM fl f JOIN split USING (clip))"


@query(f"""WITH {CURVE}, {_lead_sql(0.35)}, a AS (SELECT clip, any_value(m) AS m, any_value(lead) AS lead, any_value(best) AS best, max(t) AS end_, max(t) FILTER (WHERE pos = best) AS at_,
        count(*) FILTER (WHERE pos < lead AND flag) AS early, avg(CASE WHEN NOT flag THEN 1.0 ELSE 0.0 END) FILTER (WHERE pos >= best) AS absent FROM ld GROUP BY clip)
    SELECT clip, CASE WHEN early >= 0.4 * lead AND best > 0 AND best < m AND end_ - at_ >= 1.0 AND absent >= 0.4 THEN round(at_, 6) END AS cut FROM a""")
def soft_cut_guards(spark, d):
    return decode.soft_cut(curve(spark, d), presence=0.4, absence=0.4, digits=6)


@query(f"""WITH {CURVE}, {_lead_sql(0.45)}, a AS (SELECT clip, any_value(m) AS m, any_value(best) AS best, max(t) FILTER (WHERE pos = best) AS at_, avg(sim) FILTER (WHERE pos < lead) AS early,
        avg(CASE WHEN NOT flag THEN 1.0 ELSE 0.0 END) FILTER (WHERE pos >= best) AS absent, median(sim) FILTER (WHERE pos >= best) AS middle FROM ld GROUP BY clip)
    SELECT clip, CASE WHEN early >= 0.4 AND best > 0 AND best < m AND absent >= 0.4 AND middle < 0.5 THEN round(at_, 6) END AS cut FROM a""")
def within_shot_refine(spark, d):
    return decode.within_shot_cut(curve(spark, d), threshold=0.5, presence=0.4, absence=0.4, digits=6)


@query(f"WITH RECURSIVE {CURVE}, {viterbi_sql()} SELECT clip, i, state FROM st")
def viterbi_states(spark, d):
    return states(spark, d).select("clip", "i", "state")


@query(SEGMENTS + " SELECT clip, run, state, i0, i1 FROM runs")
def state_runs(spark, d):
    return series.runs(states(spark, d)).select("clip", "run", "state", "i0", "i1")


@query(SEGMENTS + " SELECT clip, seg_idx, round(start_, 6) AS start, round(end_, 6) AS \"end\", CASE state WHEN 0 THEN 'person' ELSE 'meme' END AS label FROM seg")
def viterbi_segments(spark, d):
    s = segments(spark, d)
    return s.select("clip", "seg_idx", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.when(F.col("state") == 0, "person").otherwise("meme").alias("label"))


@query(SEGMENTS + """ SELECT clip, count(*) AS n_segments, string_agg(CASE state WHEN 0 THEN 'pers' ELSE 'meme' END, '→' ORDER BY seg_idx) AS pattern,
    string_agg(CASE state WHEN 0 THEN 'creator' ELSE 'meme' END, ' → ' ORDER BY seg_idx) AS pretty FROM seg GROUP BY clip""")
def pattern_string(spark, d):
    s = segments(spark, d).withColumn("label", F.when(F.col("state") == 0, "person").otherwise("meme")).withColumn("dur", F.lit(0.0)).withColumn("face_sim", F.lit(0.0))
    return place.segment_documents(s).select("clip", "n_segments", "pattern", X.pretty_pattern(F.col("pattern")).alias("pretty"))


LUMA = "lum AS (SELECT clip, i, t, (event_id_ * 37 % 256)::DOUBLE AS luma FROM (SELECT clip, i, t, i + clip AS event_id_ FROM curve))"


def luma(spark, d):
    return luma_of(curve(spark, d))


def luma_of(c: DataFrame) -> DataFrame:
    return c.select("clip", "i", "t", ((F.col("i") + F.col("clip")) * 37 % 256).cast("double").alias("luma"))




def fade_sql(threshold: float, hard_step: float, back: float, forward: float) -> str:
    return f"""bnd AS (SELECT clip, seg_idx, start_ AS b, lag(state) OVER w = 1 AND state = 0 AS returns_, lag(state) OVER w AS prev FROM seg WINDOW w AS (PARTITION BY clip ORDER BY seg_idx)),
    w0 AS (SELECT b.clip, b.b, l.i, l.t, l.luma, c.sim FROM (SELECT DISTINCT clip, b FROM bnd WHERE prev IS NOT NULL) b JOIN lum l ON b.clip = l.clip AND l.t >= b.b - {back} AND l.t <= b.b + {forward} JOIN curve c ON c.clip = l.clip AND c.i = l.i),
    w1 AS (SELECT *, abs(lead(luma) OVER (PARTITION BY clip, b ORDER BY i) - luma) AS jump FROM w0),
    fade AS (SELECT clip, b, CASE WHEN count(*) >= 3 AND coalesce(max(jump), 0) <= {hard_step} THEN CASE
        WHEN min(luma) FILTER (WHERE sim < {threshold}) <= 48 THEN (list(t ORDER BY luma, i) FILTER (WHERE sim < {threshold}))[1]
        WHEN max(luma) FILTER (WHERE sim < {threshold}) >= 212 THEN (list(t ORDER BY luma DESC, i) FILTER (WHERE sim < {threshold}))[1] END END AS fade FROM w1 GROUP BY clip, b)"""


FADE = f"{LUMA}, {fade_sql(0.5, 200, 20, 30)}"


@query(SEGMENTS + f", {FADE} SELECT clip, round(b, 6) AS b, round(fade, 6) AS fade FROM fade")
def fade_refine(spark, d):
    b = segments(spark, d).filter("seg_idx > 0").select("clip", F.col("start").alias("b"))
    f = place.fade_times(b, luma(spark, d), curve(spark, d), threshold=0.5, hard_step=200.0, back=20.0, forward=30.0)
    return f.select("clip", F.round("b", 6).alias("b"), F.round("fade", 6).alias("fade"))


@query(SEGMENTS + """, c AS (SELECT clip, t FROM curve WHERE event_type = 'purchase'),
    bnd AS (SELECT *, lag(state) OVER (PARTITION BY clip ORDER BY seg_idx) AS prev FROM seg),
    mv AS (SELECT clip, seg_idx, start_, end_, state, CASE WHEN prev IS NOT NULL THEN round(coalesce(
        CASE WHEN prev = 1 AND state = 0 THEN (SELECT c.t FROM c WHERE c.clip = bnd.clip AND c.t >= start_ - 24 AND c.t <= start_ + 9 ORDER BY abs(c.t - start_), c.t LIMIT 1) END,
        (SELECT c.t FROM c WHERE c.clip = bnd.clip AND abs(c.t - start_) <= 6 ORDER BY abs(c.t - start_), c.t LIMIT 1)), 6) END AS new_ FROM bnd),
    o AS (SELECT clip, seg_idx, coalesce(new_, start_) AS s, coalesce(lead(new_) OVER (PARTITION BY clip ORDER BY seg_idx), end_) AS e, state FROM mv)
    SELECT clip, seg_idx, state, round(s, 6) AS start, round(e, 6) AS "end", e - s <= 0 AS negative_dur FROM o""")
def place_boundaries(spark, d):
    config = place.Config(snap_window=6.0, refine=False, return_back=24.0, return_forward=9.0)
    p = place.place_boundaries(segments(spark, d), times_of(spark, d, "purchase"), luma(spark, d), curve(spark, d), config, 6)
    return p.select("clip", "seg_idx", "state", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "negative_dur")


#: The clip driver on these tables, whose clock is in hours.
DRIVER = place.Config(snap_window=6.0, return_back=24.0, return_forward=9.0, fade_back=20.0, fade_forward=30.0, hard_step=200.0)


def driver_sql(thr: str, pen: str, own: str = "clip") -> str:
    """Decoded and placed segments of curve and clips (clip, dur, first_, method); thr, pen and the clip's own number are expressions of clip."""
    return f"""
    seed AS (SELECT c.clip, coalesce(max(i) FILTER (WHERE t <= first_), 0) AS seed, {thr} AS thr, {pen} AS pen FROM curve c JOIN clips USING (clip) WHERE first_ IS NOT NULL GROUP BY c.clip),
    lead_ AS (SELECT clip, i, t, sim, seed, thr, pen, 1e9::DOUBLE AS d FROM curve JOIN seed USING (clip) WHERE i = 0
        UNION ALL SELECT c.clip, c.i, c.t, c.sim, l.seed, l.thr, l.pen, CASE WHEN c.i <= l.seed THEN 1e9::DOUBLE ELSE greatest(least(l.d, l.pen), -l.pen) + 2.0::DOUBLE * (c.sim - l.thr) END
        FROM lead_ l JOIN curve c ON c.clip = l.clip AND c.i = l.i + 1),
    sure_ AS (SELECT *, CASE WHEN d > pen THEN 0 WHEN d < -pen THEN 1 WHEN i = max(i) OVER (PARTITION BY clip) THEN CASE WHEN d >= 0 THEN 0 ELSE 1 END END AS sure FROM lead_),
    st AS (SELECT clip, i, t, sim, CAST(first_value(sure IGNORE NULLS) OVER (PARTITION BY clip ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS state FROM sure_),
    {RUNS.replace("seg AS", "seg0 AS")},
    seg AS MATERIALIZED (SELECT clip, seg_idx, round(start_, 6) AS start_, round(end_, 6) AS end_, state FROM seg0
        UNION ALL SELECT clip, 0, 0.0, round(dur, 6), CASE WHEN method = 'all_meme_no_creator' THEN 1 ELSE 0 END FROM clips WHERE first_ IS NULL),
    lum AS (SELECT clip, i, t, ((i + {own}) * 37 % 256)::DOUBLE AS luma FROM curve), {fade_sql(0.35, 200, 20, 30)},
    cut_ AS (SELECT clip, t FROM curve WHERE event_type = 'purchase'),
    near_ AS (SELECT b.clip, b.b, arg_min(c.t, (abs(c.t - b.b), c.t)) FILTER (WHERE abs(c.t - b.b) <= 6) AS near_cut, arg_min(c.t, (abs(c.t - b.b), c.t)) FILTER (WHERE c.t >= b.b - 24 AND c.t <= b.b + 9) AS return_cut
        FROM (SELECT DISTINCT clip, b FROM bnd WHERE prev IS NOT NULL) b JOIN cut_ c USING (clip) GROUP BY b.clip, b.b),
    moves AS (SELECT s.clip, s.seg_idx, s.start_, s.end_, s.state, bnd.prev, CASE WHEN bnd.returns_ THEN return_cut END AS return_cut, fade, near_cut
        FROM seg s JOIN bnd ON s.clip = bnd.clip AND s.seg_idx = bnd.seg_idx LEFT JOIN near_ n ON n.clip = s.clip AND n.b = bnd.b AND bnd.prev IS NOT NULL LEFT JOIN fade f ON f.clip = s.clip AND f.b = bnd.b AND bnd.prev IS NOT NULL)"""


def placed_sql(name: str, fade: str) -> str:
    return f"""{name}_ AS (SELECT *, CASE WHEN prev IS NOT NULL THEN round(coalesce(return_cut, {fade}, near_cut), 6) END AS new_ FROM moves),
    {name} AS (SELECT clip, seg_idx, state, coalesce(new_, start_) AS s, coalesce(lead(new_) OVER (PARTITION BY clip ORDER BY seg_idx), end_) AS e FROM {name}_)"""


FIRST = "CASE WHEN {c} % 7 = 0 THEN CASE WHEN {c} % 14 = 0 THEN 30.0::DOUBLE END WHEN {c} % 5 <> 0 THEN 5.0::DOUBLE END AS first_, CASE WHEN {c} % 5 = 0 THEN 'all_meme_no_creator' WHEN {c} % 5 = 1 THEN '' ELSE 'creator_to_meme' END AS method"


def clip_records(c: DataFrame) -> DataFrame:
    method = F.when(F.col("clip") % 5 == 0, "all_meme_no_creator").when(F.col("clip") % 5 == 1, "").otherwise("creator_to_meme")
    return durations(c).select("clip", "dur", (F.col("clip") % 7 == 0).alias("has_first"), F.when(F.col("clip") % 14 == 0, F.lit(30.0)).alias("first_true"), F.when(F.col("clip") % 5 != 0, F.lit(5.0)).alias("base_cut"), method.alias("method"))


@query(f"""WITH RECURSIVE {CURVE}, clips AS (SELECT clip, dur, {FIRST.format(c="clip")} FROM dur), {driver_sql("0.32::DOUBLE", "1.0::DOUBLE")}, {placed_sql("p", "fade")},
    sims AS (SELECT p.clip, p.seg_idx, coalesce(round(median(sim), 6), 0.0) AS face_sim FROM p LEFT JOIN curve c ON c.clip = p.clip AND c.t >= s AND c.t < e GROUP BY p.clip, p.seg_idx),
    agg AS (SELECT p.clip, count(*) AS n_segments, string_agg(CASE state WHEN 0 THEN 'pers' ELSE 'meme' END, '→' ORDER BY seg_idx) AS pattern, round(sum(face_sim), 6) AS sim_sum, round(sum(e - s), 6) AS dur_sum,
        max(CASE WHEN seg_idx = 1 THEN s END) AS cut, count(CASE WHEN state = 0 THEN 1 END) AS people FROM p JOIN sims USING (clip, seg_idx) GROUP BY p.clip)
    SELECT clip, n_segments, pattern, sim_sum, dur_sum, round(cut, 6) AS cut, CASE WHEN first_ IS NULL THEN method WHEN people > 1 THEN 'creator_returns' ELSE coalesce(nullif(method, ''), 'creator_to_meme') END AS method FROM agg JOIN clips USING (clip)""")
def segment_clips(spark, d):
    """The whole clip driver with every step on."""
    c = keep(curve(spark, d))
    s, decisions = place.segment_clips(clip_records(c), c, c.filter("event_type = 'purchase'").select("clip", "t"), luma_of(c), DRIVER, 6)
    total = lambda f: F.round(F.aggregate(f"segments.{f}", F.lit(0.0), lambda a, x: a + x), 6)
    docs = place.segment_documents(s).select("clip", "n_segments", "pattern", total("face_sim").alias("sim_sum"), total("dur").alias("dur_sum"))
    return docs.join(decisions, "clip").select("clip", "n_segments", "pattern", "sim_sum", "dur_sum", F.round("cut", 6).alias("cut"), "method")


@query(f"WITH RECURSIVE {CURVE}, {LISTS}, {greedy_sql('lists', TOL)} SELECT clip, tp, missed, extra, round(error_, 6) AS error FROM matched")
def greedy_match(spark, d):
    m = match.greedy_match(cut_lists(spark, d), TOL)
    return m.select("clip", "tp", "missed", "extra", F.round(F.aggregate("errors", F.lit(0.0), lambda a, x: a + x), 6).alias("error"))


@query(f"WITH RECURSIVE {CURVE}, {LISTS}, {greedy_sql('lists', TOL)} SELECT {VERDICT_SQL} AS verdict, count(*) AS n FROM matched GROUP BY 1")
def verdicts(spark, d):
    return match.with_verdict(match.greedy_match(cut_lists(spark, d), TOL)).groupBy("verdict").agg(F.count("*").alias("n"))


TOTALS = """CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(extra) AS BIGINT) AS extra, count(*) AS clips, count(CASE WHEN missed = 0 AND extra = 0 THEN 1 END) AS full_,
    CASE WHEN sum(tp) + sum(extra) = 0 THEN 100.0 ELSE 100.0 * sum(tp)::DOUBLE / (sum(tp) + sum(extra))::DOUBLE END AS precision_, CASE WHEN sum(tp) + sum(missed) = 0 THEN 100.0 ELSE 100.0 * sum(tp)::DOUBLE / (sum(tp) + sum(missed))::DOUBLE END AS recall_,
    sum(error_) / nullif(sum(tp), 0)::DOUBLE AS mean_error"""


@query(f"WITH RECURSIVE {CURVE}, {LISTS}, {greedy_sql('lists', TOL)} SELECT tp, missed, extra, clips, full_ AS \"full\", round(precision_, 6) AS precision, round(recall_, 6) AS recall, round(mean_error, 6) AS mean_error FROM (SELECT {TOTALS} FROM matched)")
def precision_recall(spark, d):
    t = match.totals(match.greedy_match(cut_lists(spark, d), TOL))
    return t.select("tp", "missed", "extra", "clips", "full", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("mean_error", 6).alias("mean_error"))


@query(f"""WITH {CURVE}, {LISTS}, o AS (SELECT truth[1] - pred[1] AS d FROM lists WHERE abs(pred[1] - truth[1]) <= 12)
    SELECT count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(avg(abs(d)), 6) AS mae FROM o""")
def first_cut_offset(spark, d):
    o = match.first_offsets(cut_lists(spark, d), 12.0)
    return o.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "mae")])


@query(f"""WITH {CURVE}, {LISTS} SELECT count(CASE WHEN CASE WHEN len(truth) = 0 AND len(pred) = 0 THEN true ELSE coalesce(abs(truth[1] - pred[1]) <= 12, false) END THEN 1 END) AS right_, count(*) AS n FROM lists""")
def first_cut_accuracy(spark, d):
    return cut_lists(spark, d).agg(F.count_if(match.first_cut_right(F.col("truth"), F.col("pred"), 12.0)).alias("right_"), F.count("*").alias("n"))


@query(f"""WITH {CURVE}, {LISTS}, g AS (SELECT clip, truth[1] AS old_, pred[1] AS new_ FROM lists)
    SELECT clip, CASE WHEN (old_ IS NULL AND new_ IS NULL) OR abs(old_ - new_) <= 5 THEN 'ok' WHEN abs(old_ - new_) <= 15 THEN 'close' ELSE 'bad' END AS grade,
    ((old_ IS NULL) <> (new_ IS NULL)) OR coalesce(abs(old_ - new_) > 5, false) AS flipped FROM g""")
def stage_score(spark, d):
    old, new = F.get("truth", F.lit(0)), F.get("pred", F.lit(0))
    return cut_lists(spark, d).select("clip", match.grade(old, new, 15.0, 5.0).alias("grade"), match.flipped(old, new, 5.0).alias("flipped"))


def _sweep_sql(tol: float) -> str:
    points = [(t, p) for t in THRESHOLDS for p in PENALTIES]
    own, pick = f"(clip // {len(points)})", lambda k: f"([{', '.join(str(x[k]) for x in points)}]::DOUBLE[])[CAST(clip % {len(points)} AS BIGINT) + 1]"
    pred = lambda name: f"{name}_l AS (SELECT clip, list(s ORDER BY seg_idx) AS pred FROM {name} WHERE seg_idx > 0 GROUP BY clip)"
    return f"""WITH RECURSIVE {CURVE.replace("curve AS MATERIALIZED", "curve0 AS MATERIALIZED").replace("FROM curve GROUP", "FROM curve0 GROUP")}, {LISTS.replace("FROM curve", "FROM curve0")},
    g AS (SELECT unnest(range({len(points)})) AS g), curve AS MATERIALIZED (SELECT clip * {len(points)} + g AS clip, i, t, sim, event_type FROM curve0, g), dur2 AS (SELECT clip * {len(points)} + g AS clip, dur FROM dur, g),
    clips AS (SELECT clip, dur, {FIRST.format(c=own)} FROM dur2), {driver_sql(pick(0), pick(1), own).replace("JOIN dur USING", "JOIN dur2 USING")}, {placed_sql("p", "fade")}, {placed_sql("q", "CAST(NULL AS DOUBLE)")}, {pred("p")}, {pred("q")},
    pairs AS (SELECT (c.clip % {len(points)}) * 2 AS cfg, c.clip AS key, l.truth, coalesce(p_l.pred, []) AS pred FROM clips c JOIN lists l ON l.clip = c.clip // {len(points)} LEFT JOIN p_l ON p_l.clip = c.clip
        UNION ALL SELECT (c.clip % {len(points)}) * 2 + 1, c.clip, l.truth, coalesce(q_l.pred, []) FROM clips c JOIN lists l ON l.clip = c.clip // {len(points)} LEFT JOIN q_l ON q_l.clip = c.clip),
    {greedy_sql("pairs", tol, "cfg, key").replace("g AS (SELECT", "gr AS (SELECT", 1).replace("FROM g WHERE k < len(truth)) g)", "FROM gr WHERE k < len(truth)) g)").replace("FROM g WHERE k = len(truth)", "FROM gr WHERE k = len(truth)")}, tt AS (SELECT cfg, {TOTALS} FROM matched GROUP BY cfg)
    SELECT CAST(cfg AS BIGINT) AS cfg, ([{', '.join(str(x[0]) for x in points)}]::DOUBLE[])[CAST(cfg // 2 AS BIGINT) + 1] AS threshold, ([{', '.join(str(x[1]) for x in points)}]::DOUBLE[])[CAST(cfg // 2 AS BIGINT) + 1] AS penalty, cfg % 2 = 0 AS refine,
        tp, missed, extra, full_ AS "full", round(precision_, 6) AS precision, round(recall_, 6) AS recall FROM tt ORDER BY full_ DESC, precision_ + recall_ DESC, cfg LIMIT 15"""


@query(_sweep_sql(12.0))
def sweep_grid(spark, d):
    """4 thresholds, 4 penalties, with and without refining, through the whole clip driver; the best 15."""
    c = keep(curve(spark, d))
    truth_cuts = c.groupBy("clip").agg(F.array_sort(F.collect_list(F.when(F.col("event_type") == "purchase", F.col("t")))).alias("truth"))
    s = sweep(spark, clip_records(c), c, c.filter("event_type = 'purchase'").select("clip", "t"), luma_of(c), truth_cuts, 12.0, config=DRIVER, digits=6)
    return s.select("cfg", "threshold", "penalty", "refine", "tp", "missed", "extra", "full", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


REVIEW = """rv AS (SELECT d.doc_id AS pos, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 'correct' WHEN toxic = 1 THEN 'missed' ELSE 'partial' END AS verdict,
    CASE WHEN n_chars % 4 <> 0 THEN (n_chars % 1000) / 100.0::DOUBLE END AS cut, n_chars % 6 AS n_shots, CASE WHEN d.doc_id % 5 = 0 THEN false WHEN d.doc_id % 5 < 4 THEN true END AS edited FROM documents d LEFT JOIN labels l USING (doc_id))"""


def review(spark, d):
    v = F.when(F.col("quality") == 1, "correct").when(F.col("toxic") == 1, "missed").when(F.col("quality").isNotNull(), "partial")
    r = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    edited = F.when(F.col("doc_id") % 5 == 0, False).when(F.col("doc_id") % 5 < 4, True)
    return r.select(F.col("doc_id").alias("pos"), v.alias("verdict"), F.when(F.col("n_chars") % 4 != 0, (F.col("n_chars") % 1000) / 100.0).alias("cut"), (F.col("n_chars") % 6).alias("n_shots"), edited.alias("edited"))


SECTION = "CASE WHEN verdict IN ('wrong_time', 'missed', 'false_positive') THEN 'problem' WHEN cut IS NULL THEN 'none' WHEN n_shots >= 4 THEN 'multicut' ELSE 'clean' END"
CATEGORY = "CASE WHEN edited = false THEN 'unlabeled' WHEN verdict IS NOT NULL AND verdict NOT IN ('correct', 'correct_none') THEN 'problem' WHEN cut IS NULL THEN 'none' WHEN n_shots > 2 THEN 'multicut' ELSE 'clean' END"


@query(f"WITH {REVIEW} SELECT pos, cut, {SECTION} AS section, row_number() OVER (ORDER BY CASE {SECTION} WHEN 'problem' THEN 0 WHEN 'none' THEN 1 WHEN 'multicut' THEN 2 ELSE 3 END, cut ASC NULLS LAST, pos) AS place FROM rv")
def report_sections(spark, d):
    r = review(spark, d).withColumn("section", report.section(F.col("verdict"), F.col("cut"), F.col("n_shots")))
    return report.placed(r, report.rank_of(F.col("section"), report.SECTIONS), F.col("cut").asc_nulls_last(), "pos").select("pos", "cut", "section", "place")


@query(f"WITH {REVIEW} SELECT pos, {CATEGORY} AS category FROM rv")
def workbench_category(spark, d):
    return review(spark, d).select("pos", report.category(F.col("edited"), F.col("verdict"), F.col("cut"), F.col("n_shots")).alias("category"))


@query(f"""WITH {REVIEW}, c AS (SELECT *, {CATEGORY} AS category FROM rv) SELECT count(CASE WHEN category = 'unlabeled' THEN 1 END) AS unlabeled, count(CASE WHEN category = 'problem' THEN 1 END) AS problem, count(CASE WHEN category = 'none' THEN 1 END) AS "none",
    count(CASE WHEN category = 'multicut' THEN 1 END) AS multicut, count(CASE WHEN category = 'clean' THEN 1 END) AS clean, count(CASE WHEN category <> 'unlabeled' THEN 1 END) AS labelled, count(CASE WHEN verdict IN ('correct', 'correct_none') THEN 1 END) AS good,
    count(CASE WHEN verdict = 'partial' THEN 1 END) AS partial, count(CASE WHEN verdict IN ('missed', 'false_positive') THEN 1 END) AS bad, (SELECT count(*) FROM labels) AS flagged, (SELECT count(CASE WHEN toxic = 1 THEN 1 END) FROM labels) AS flagged_bad FROM c""")
def workbench_totals(spark, d):
    r = review(spark, d).withColumn("category", report.category(F.col("edited"), F.col("verdict"), F.col("cut"), F.col("n_shots")))
    return report.workbench_counts(r, table(spark, d, "labels").select(F.when(F.col("toxic") == 1, "bad").otherwise("ok").alias("flag")))


@query(f"""WITH {REVIEW}, s AS (SELECT count(*) AS total, count(CASE WHEN verdict = 'correct' THEN 1 END) AS correct, count(CASE WHEN verdict = 'close' THEN 1 END) AS close, count(CASE WHEN verdict = 'correct_none' THEN 1 END) AS correct_none,
    count(CASE WHEN verdict IN ('missed', 'false_positive', 'wrong_time') THEN 1 END) AS problems FROM rv WHERE verdict IS NOT NULL)
    SELECT *, round(100.0::DOUBLE * (correct + correct_none) / total, 1) AS strict_percent, round((100.0::DOUBLE * (correct + correct_none) + 100.0::DOUBLE * close) / total, 1) AS within_percent FROM s""")
def summary_counts(spark, d):
    return report.verdict_summary(review(spark, d).filter("verdict is not null"))


@query(f"WITH {REVIEW}, c AS (SELECT coalesce(verdict, 'unlabelled') AS verdict, pos FROM rv) SELECT verdict, count(*) AS n FROM c GROUP BY verdict ORDER BY n DESC, min(pos)")
def category_counts(spark, d):
    return report.counts_by(review(spark, d).withColumn("verdict", F.coalesce("verdict", F.lit("unlabelled"))), "verdict")


@query("""WITH l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 1.5::DOUBLE END AS cut, 'l' AS note FROM labels WHERE doc_id % 3 = 0), s AS (SELECT doc_id, CASE WHEN quality = 1 THEN 2.5::DOUBLE END AS cut, 's' AS note FROM labels WHERE doc_id % 2 = 0),
    t AS (SELECT doc_id, n_chars / 8.0::DOUBLE AS cut, CASE WHEN lang = 'en' THEN 't' END AS note FROM documents WHERE doc_id % 7 <> 0)
    SELECT d.doc_id, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN l.cut ELSE s.cut END, t.cut) AS cut, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN l.note ELSE s.note END, t.note) AS note,
    CASE WHEN l.doc_id IS NOT NULL THEN 'local' WHEN s.doc_id IS NOT NULL THEN 'second' WHEN t.doc_id IS NOT NULL THEN 'third' ELSE 'none' END AS label_source
    FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""")
def coalesce_truth(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    local = labels.filter("doc_id % 3 = 0").select("doc_id", F.when(F.col("toxic") == 1, F.lit(1.5)).alias("cut"), F.lit("l").alias("note"))
    second = labels.filter("doc_id % 2 = 0").select("doc_id", F.when(F.col("quality") == 1, F.lit(2.5)).alias("cut"), F.lit("s").alias("note"))
    third = docs.filter("doc_id % 7 <> 0").select("doc_id", (F.col("n_chars") / 8.0).alias("cut"), F.when(F.col("lang") == "en", "t").alias("note"))
    return truth.merge_sources(docs.select("doc_id"), local, second, third, "doc_id", ["cut", "note"])


@query(f"""WITH {CURVE}, e AS (SELECT clip, greatest(round(t - 20, 3), 0.0) AS sec FROM curve WHERE event_type = 'click'),
    g AS (SELECT clip, sec, sec - lag(sec) OVER (PARTITION BY clip ORDER BY sec) AS gap FROM e), k AS (SELECT clip, sec, row_number() OVER (PARTITION BY clip ORDER BY sec) - 1 AS k FROM g WHERE gap IS NULL OR gap > 0.0005)
    SELECT clip, k, sec, CASE WHEN k % 2 = 0 THEN 'meme' ELSE 'person' END AS "to" FROM k""")
def normalize_events(spark, d):
    return truth.normalise_events(curve(spark, d).filter("event_type = 'click'").select("clip", (F.col("t") - 20).alias("sec")))


@query("""SELECT doc_id, CASE WHEN n = 1 THEN 'person->meme' WHEN n = 2 THEN 'person->meme->person' WHEN n >= 3 THEN 'person->meme->person->meme' WHEN cur LIKE 'all%' THEN cur ELSE '' END AS pattern
    FROM (SELECT doc_id, n_chars % 5 AS n, CASE WHEN lang = 'en' THEN 'all person' WHEN lang = 'de' THEN 'person->meme' END AS cur FROM documents)""")
def pattern_by_count(spark, d):
    cur = F.when(F.col("lang") == "en", "all person").when(F.col("lang") == "de", "person->meme")
    return table(spark, d, "documents").select("doc_id", truth.predict_pattern(F.col("n_chars") % 5, cur).alias("pattern"))


@query(SEGMENTS + """, k AS (SELECT *, CASE state WHEN 0 THEN 'person' ELSE 'meme' END AS label, count(*) OVER (PARTITION BY clip) AS n, row_number() OVER (PARTITION BY clip, state ORDER BY seg_idx) AS k FROM seg WHERE clip % 9 <> 1),
    u AS (SELECT user_id AS clip, concat('u', user_id, '.mp4') AS name, user_id % 10 <> 3 AS ex FROM events GROUP BY user_id),
    p AS (SELECT u.clip, name, CASE WHEN NOT ex THEN 'skip_missing_src' WHEN n IS NULL THEN 'skip_no_segments' WHEN n = 1 THEN 'single_segment' ELSE concat('multi_', n, 'seg') END AS disposition, ex AND n IS NOT NULL AS ok, seg_idx, label, k, start_, end_, n,
        row_number() OVER (PARTITION BY u.clip ORDER BY seg_idx, start_) AS rn FROM u LEFT JOIN k ON u.clip = k.clip)
    SELECT clip, disposition, CASE WHEN ok THEN seg_idx END AS seg_idx, CASE WHEN ok THEN concat('split/', label, '/u', clip, '_', label, '_', k, '.mp4') END AS file, CASE WHEN ok THEN round(end_ - start_, 6) END AS dur,
        CASE WHEN ok AND n = 1 THEN 'copy' WHEN ok THEN 'cut' END AS mode FROM p WHERE disposition <> 'skip_missing_src' OR rn = 1""")
def split_plan(spark, d):
    s = segments(spark, d).filter("clip % 9 <> 1").withColumn("label", F.when(F.col("state") == 0, "person").otherwise("meme"))
    clips = table(spark, d, "events").select(F.col("user_id").alias("clip")).distinct().select("clip", F.concat(F.lit("u"), F.col("clip").cast("string"), F.lit(".mp4")).alias("name"), (F.col("clip") % 10 != 3).alias("exists"))
    return report.split_plan(s, clips).select("clip", "disposition", "seg_idx", "file", F.round("dur", 6).alias("dur"), "mode")


@query(f"WITH {SHOTS}, p AS (SELECT *, lag(label) OVER w AS pl, lag(i) OVER w AS pi FROM sh WINDOW w AS (PARTITION BY clip ORDER BY i)) SELECT clip, i AS shot_idx, label FROM p WHERE pi IS NOT NULL AND pl IS DISTINCT FROM label")
def label_flips(spark, d):
    return series.label_flips(shots(spark, d).select("clip", F.col("i").alias("shot_idx"), "label"))


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS urgent FROM orders), a AS (SELECT o_orderkey, urgent, count(l_orderkey) AS n, count(CASE WHEN 1 - l_discount >= 0.95 AND l_quantity / 50 >= 0.4 THEN 1 END) AS good FROM o LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    f AS (SELECT CASE WHEN n = 0 AND urgent THEN 1 ELSE n END AS all_, CASE WHEN n = 0 AND urgent THEN 1 ELSE good END AS good, n = 0 AS tried, n = 0 AND urgent AS rescued FROM a)
    SELECT count(*) AS frames, CAST(sum(all_) AS BIGINT) AS det_faces, count(CASE WHEN all_ > 0 THEN 1 END) AS det_frames_with_face, CAST(sum(good) AS BIGINT) AS faces, count(CASE WHEN good > 0 THEN 1 END) AS frames_with_face, count(CASE WHEN tried THEN 1 END) AS lowlight_tried, count(CASE WHEN rescued THEN 1 END) AS lowlight_rescued,
    round(100.0::DOUBLE * count(CASE WHEN all_ > 0 THEN 1 END) / count(*), 2) AS det_frames_with_face_percent, round(100.0::DOUBLE * count(CASE WHEN good > 0 THEN 1 END) / count(*), 2) AS frames_with_face_percent FROM f""")
def detection_stats(spark, d):
    box = lambda h: F.array(F.lit(0.0), F.lit(0.0), h, h)
    f = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(box(F.col("l_quantity")).alias("bbox"), (1 - F.col("l_discount")).alias("det_score"))).alias("faces"))
    none = F.array().cast("array<struct<bbox:array<double>,det_score:double>>")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(f, "o_orderkey", "left")
    enhanced = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.struct(box(F.lit(50.0)).alias("bbox"), F.lit(1.0).alias("det_score")))).otherwise(none)
    frames = o.select(F.coalesce("faces", none).alias("faces"), enhanced.alias("faces_enhanced"), F.lit(50).alias("height"))
    return identity.detection_stats(identity.gate_faces(identity.retry_empty(frames), 0.95, 0.4))


@query("""SELECT c_mktsegment, count(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 1 END) AS with_orders, count(CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 1 END) AS without_orders FROM customer GROUP BY c_mktsegment""")
def semi_anti_exists(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    have = c.join(o, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("with_orders"))
    lack = c.join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("without_orders"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return have.join(lack, "c_mktsegment", "full").select("c_mktsegment", zero("with_orders"), zero("without_orders"))


@query("SELECT doc_id, CASE WHEN lang <> 'de' THEN n_chars END AS n_chars, CASE WHEN lang = 'de' THEN 'no frames' END AS error FROM documents")
def error_row_union(spark, d):
    docs = table(spark, d, "documents")
    good = docs.filter("lang <> 'de' or lang is null").select("doc_id", "n_chars")
    return report.with_errors(good, docs.filter("lang = 'de'").select("doc_id", F.lit("no frames").alias("error"))).select("doc_id", "n_chars", "error")


@query(f"WITH {REVIEW} SELECT pos AS clip, cut, greatest(0.0, cut - 0.15::DOUBLE) AS qa_before, cut + 0.15::DOUBLE AS qa_after FROM rv WHERE cut IS NOT NULL")
def qa_frames(spark, d):
    return report.qa_frames(review(spark, d).select(F.col("pos").alias("clip"), "cut"))


@query(f"""WITH {REVIEW} SELECT pos, CASE WHEN coalesce(edited, false) THEN cut END AS cut, coalesce(edited, false) AND ((CASE WHEN n_shots > 0 THEN cut END IS NULL) <> (n_shots = 5)
    OR coalesce(abs(CASE WHEN n_shots > 0 THEN cut END - CASE WHEN n_shots <> 5 THEN 4.0 END) > 0.05, false)) AS differs FROM rv""")
def blank_and_differs(spark, d):
    r = review(spark, d)
    diff = truth.differs(F.col("edited"), F.col("n_shots") > 0, F.col("cut"), F.when(F.col("n_shots") != 5, F.lit(4.0)))
    return truth.blank_unedited(r.withColumn("differs", diff), {"cut": F.lit(None)}).select("pos", "cut", "differs")


@query(f"""WITH {CURVE} SELECT clip, i, CASE WHEN sim >= 0.35 THEN 'green' WHEN sim >= 0.35 - 0.10::DOUBLE THEN 'yellow' ELSE 'red' END AS band, repeat('#', CAST(trunc(sim * 40) AS INTEGER)) AS bar,
    round(t / greatest(max(t) OVER (PARTITION BY clip), 1.0) * 100, 6) AS percent FROM curve""")
def bands_and_bars(spark, d):
    c = curve(spark, d).withColumn("dur", F.max("t").over(Window.partitionBy("clip")))
    return c.select("clip", "i", X.similarity_band(F.col("sim"), 0.35).alias("band"), X.bar(F.col("sim")).alias("bar"), F.round(X.percent_of(F.col("t"), F.col("dur")), 6).alias("percent"))


@query("""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, left(coalesce(url, ''), 45) AS notes,
    CASE WHEN page_id % 3 = 0 THEN 'none' ELSE printf('%.2fs', page_id / 4.0::DOUBLE) END AS cut_text, printf('%02d_%s.mp4', page_id % 7, 'meme') AS file FROM pages""")
def card_texts(spark, d):
    t = F.when(F.col("page_id") % 3 != 0, F.col("page_id") / 4.0)
    return table(spark, d, "pages").select("page_id", X.html_escape(F.col("html")).alias("escaped"), X.head(F.col("url")).alias("notes"), X.seconds(t).alias("cut_text"), X.segment_file((F.col("page_id") % 7), F.lit("meme")).alias("file"))


@query(f"""WITH {CURVE}, s AS (SELECT clip, i, t AS start_, lead(t) OVER (PARTITION BY clip ORDER BY i) AS end_ FROM curve WHERE event_type = 'view'),
    k AS (SELECT clip, i, start_, end_, start_ + (end_ - start_) * (k + 0.5::DOUBLE) / 3 AS at_, k FROM s, unnest(range(3)) u(k) WHERE end_ IS NOT NULL),
    j AS (SELECT k.clip, k.i, k.k, c.sim, row_number() OVER (PARTITION BY k.clip, k.i, k.k ORDER BY abs(c.t - at_), c.t, c.i) AS rn FROM k JOIN curve c ON k.clip = c.clip)
    SELECT clip, i AS shot_idx, round(median(sim), 6) AS sim FROM j WHERE rn = 1 GROUP BY clip, i""")
def shot_medians(spark, d):
    c = curve(spark, d)
    s = c.filter("event_type = 'view'").select("clip", F.col("i").alias("shot_idx"), F.col("t").alias("start"), F.lead("t").over(Window.partitionBy("clip").orderBy("i")).alias("end")).filter("end is not null")
    return identity.shot_medians(s, c).select("clip", "shot_idx", F.round("sim", 6).alias("sim"))


@query(f"""WITH {CURVE}, s AS (SELECT clip, i, t + 0.7 AS start_, t + 5.3 AS end_ FROM curve WHERE event_type = 'error'), f AS (SELECT clip, i AS idx, t AS pts FROM curve WHERE event_type <> 'error'),
    a AS (SELECT s.clip, s.i, (SELECT idx FROM f WHERE f.clip = s.clip ORDER BY abs(pts - start_), pts LIMIT 1) AS sf, (SELECT idx FROM f WHERE f.clip = s.clip ORDER BY abs(pts - end_), pts LIMIT 1) AS ef FROM s)
    SELECT a.clip, a.i AS shot_idx, sf AS start_frame, ef AS end_frame, round(x.t, 3) AS start, round(y.t, 3) AS "end" FROM a JOIN curve x ON x.clip = a.clip AND x.i = sf JOIN curve y ON y.clip = a.clip AND y.i = ef""")
def project_true_clock(spark, d):
    c = curve(spark, d)
    s = c.filter("event_type = 'error'").select("clip", F.col("i").alias("shot_idx"), (F.col("t") + 0.7).alias("start"), (F.col("t") + 5.3).alias("end"))
    frames = c.filter("event_type <> 'error'").select("clip", F.col("i").alias("idx"), F.col("t").alias("pts"))
    return series.true_clock(s, frames).select("clip", "shot_idx", "start_frame", "end_frame", "start", "end")


@query(f"WITH {CURVE}, f AS (SELECT clip, min(t) FILTER (WHERE event_type = 'purchase') AS first_ FROM curve GROUP BY clip) SELECT c.clip, coalesce(max(i) FILTER (WHERE t <= first_), 0) AS seed FROM curve c JOIN f USING (clip) GROUP BY c.clip")
def seed_index(spark, d):
    c = curve(spark, d)
    return decode.seed_index(c, c.filter("event_type = 'purchase'").groupBy("clip").agg(F.min("t").alias("first")))


ONE = """one AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY us, event_id) - 1 AS BIGINT) AS i, (us - min(us) OVER ()) / 3.6e9 AS t, least(value, 100.0::DOUBLE) / 100.0::DOUBLE AS sim, event_type
    FROM (SELECT epoch_us(ts) AS us, event_id, value, event_type FROM events))"""


def one_clip(spark, d) -> DataFrame:
    """All events as one clip, which no task may hold alone."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    e = table(spark, d, "events").select(F.lit(0).alias("clip"), "event_id", us.alias("us"), "value", "event_type", F.lit(1).alias("row"))
    first = e.agg(F.min("us").alias("first"))  # a row
    e = folded(e, ["us", "event_id"], {"n": ("sum", "row")}, long=True).crossJoin(F.broadcast(first))
    return keep(e.select("clip", (F.col("n") - 1).alias("i"), ((F.col("us") - F.col("first")) / F.lit(HOUR)).alias("t"), (F.least("value", F.lit(100.0)) / 100.0).alias("sim"), "event_type"))


@query(f"""WITH {ONE}, f AS (SELECT i AS idx, t AS pts FROM one WHERE event_type <> 'purchase'),
    b AS (SELECT p.i AS probe, p.t, f.idx, f.pts FROM one p ASOF JOIN (SELECT min(idx) AS idx, pts FROM f GROUP BY pts) f ON p.t >= f.pts WHERE p.event_type = 'purchase'),
    a AS (SELECT p.i AS probe, p.t, f.idx, f.pts FROM one p ASOF JOIN (SELECT min(idx) AS idx, pts FROM f GROUP BY pts) f ON p.t <= f.pts WHERE p.event_type = 'purchase'),
    u AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY abs(pts - t), pts) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
    SELECT probe, idx, round(pts, 6) AS pts FROM u WHERE rn = 1""")
def long_clip_nearest(spark, d):
    """Nearest-time lookup in one clip that holds the whole table."""
    c = one_clip(spark, d)
    probes = c.filter("event_type = 'purchase'").select("clip", F.col("i").alias("probe"), F.col("t").alias("at"))
    frames = c.filter("event_type <> 'purchase'").select("clip", F.col("i").alias("idx"), F.col("t").alias("pts"))
    return series.nearest(probes, frames, long=True).select("probe", "idx", F.round("pts", 6).alias("pts"))


@query(f"""WITH {ONE}, st AS (SELECT 0 AS clip, i, t, sim, CASE WHEN sim >= 0.35 THEN 0 ELSE 1 END AS state FROM one), dur AS (SELECT 0 AS clip, max(t) AS dur FROM one), {RUNS}
    SELECT s.seg_idx, s.state, round(start_, 6) AS start, round(end_, 6) AS "end", coalesce(round(median(sim), 6), 0.0) AS face_sim FROM seg s LEFT JOIN one c ON c.t >= s.start_ AND c.t < s.end_ GROUP BY ALL""")
def long_clip_segments(spark, d):
    """Runs, segments and their medians in one clip that holds the whole table."""
    c = one_clip(spark, d)
    rows = series.runs(c.withColumn("state", F.when(F.col("sim") >= 0.35, 0).otherwise(1)), long=True)
    s = keep(series.run_segments(rows, durations(c)))
    m = series.interval_median(s, c, 6, long=True)
    return m.select("seg_idx", "state", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "face_sim")


@query(f"WITH {ONE}, fl AS (SELECT 0 AS clip, i, sim >= 0.35 AS flag FROM one), {SPLIT} SELECT n, best FROM split")
def long_clip_split(spark, d):
    """The best split of one clip that holds the whole table."""
    return decode.best_split(one_clip(spark, d).withColumn("flag", F.col("sim") >= 0.35), long=True).select("n", "best")


def of_kind(c: DataFrame, kind: str, name: str) -> DataFrame:
    """(clip, name): the ordered times of one kind of event."""
    return c.filter(F.col("event_type") == kind).groupBy("clip").agg(F.array_sort(F.collect_list("t")).alias(name))


EVALUATED = f"""ev2 AS (SELECT DISTINCT clip FROM curve), kinds AS (SELECT clip, list(t ORDER BY t) FILTER (WHERE event_type = 'purchase') AS cuts_, list(t ORDER BY t) FILTER (WHERE event_type = 'signup' AND clip % 3 <> 0) AS starts,
        list(t ORDER BY t) FILTER (WHERE event_type = 'click' AND clip % 5 <> 0) AS flips FROM curve GROUP BY clip),
    base AS (SELECT clip, CASE WHEN clip % 4 <> 0 AND len(cuts_) > 0 THEN cuts_ WHEN clip % 8 <> 0 THEN [12.5::DOUBLE] ELSE CAST([] AS DOUBLE[]) END AS truth, starts, flips, CASE WHEN clip % 5 <> 0 THEN flips[1] END AS picked FROM kinds),
    lists2 AS (SELECT clip, 'flips' AS rule, truth, CASE WHEN starts IS NOT NULL THEN starts[2:] ELSE coalesce(flips, []) END AS pred FROM base
        UNION ALL SELECT clip, 'pick', truth, CASE WHEN len(starts) > 1 THEN starts[2:] WHEN picked IS NOT NULL THEN [picked] ELSE [] END FROM base
        UNION ALL SELECT clip, 'none', truth, coalesce(starts[2:], []) FROM base)"""


@query(f"""WITH RECURSIVE {CURVE}, {EVALUATED}, {greedy_sql("lists2", TOL, "clip, rule")} SELECT clip, rule, tp, missed, extra, round(error_, 6) AS error, {VERDICT_SQL} AS verdict,
    CASE WHEN len(truth) = 0 AND len(pred) = 0 THEN true ELSE coalesce(abs(truth[1] - pred[1]) <= {TOL}, false) END AS first_right FROM matched""")
def evaluate_predictions(spark, d):
    """Truth left join segments left join records, under the three rules for clips without segments."""
    c = keep(curve(spark, d))
    cuts = c.select("clip").distinct().join(of_kind(c, "purchase", "cuts"), "clip", "left")
    gt = cuts.select("clip", F.when(F.col("clip") % 4 != 0, F.col("cuts")).alias("cuts"), F.when(F.col("clip") % 8 != 0, F.lit(12.5)).alias("cut"))
    order = F.row_number().over(Window.partitionBy("clip").orderBy("t")) - 1
    s = c.filter("event_type = 'signup' and clip % 3 <> 0").select("clip", order.alias("seg_idx"), F.col("t").alias("start"))
    r = of_kind(c.filter("clip % 5 <> 0"), "click", "flips").withColumn("picked", F.get("flips", F.lit(0)))
    out = None
    for rule in match.RULES:
        e = match.evaluation(gt, s, r, TOL, rule).withColumn("rule", F.lit(rule))
        out = e if out is None else out.unionByName(e)
    return out.select("clip", "rule", "tp", "missed", "extra", F.round(F.aggregate("errors", F.lit(0.0), lambda a, x: a + x), 6).alias("error"), "verdict", "first_right")


@query(f"""WITH {CURVE}, {LISTS}, g AS (SELECT truth[1] AS old_, pred[1] AS new_ FROM lists), k AS (SELECT CASE WHEN (old_ IS NULL AND new_ IS NULL) OR abs(old_ - new_) <= 5 THEN 'ok' WHEN abs(old_ - new_) <= 15 THEN 'close' ELSE 'bad' END AS grade,
        ((old_ IS NULL) <> (new_ IS NULL)) OR coalesce(abs(old_ - new_) > 5, false) AS flipped FROM g),
    t AS (SELECT count(*) AS clips, count(CASE WHEN grade = 'ok' THEN 1 END) AS ok, count(CASE WHEN grade = 'close' THEN 1 END) AS close, count(CASE WHEN grade = 'bad' THEN 1 END) AS bad, count(CASE WHEN flipped THEN 1 END) AS flipped FROM k)
    SELECT *, round(100.0::DOUBLE * ok / clips, 1) AS ok_percent, round(100.0::DOUBLE * (ok + close) / clips, 1) AS within_percent FROM t""")
def stage_totals(spark, d):
    old, new = F.get("truth", F.lit(0)), F.get("pred", F.lit(0))
    return match.grade_totals(cut_lists(spark, d).select(match.grade(old, new, 15.0, 5.0).alias("grade"), match.flipped(old, new, 5.0).alias("flipped")))


@query(f"""WITH {CURVE}, {LISTS}, g AS (SELECT clip AS pos, truth[1] AS old_, pred[1] AS new_, truth[2] AS true_ FROM lists) SELECT pos, round(old_, 6) AS old_cut, round(new_, 6) AS new_cut, round(true_, 6) AS true_cut FROM g
    WHERE ((old_ IS NULL) <> (new_ IS NULL)) OR coalesce(abs(old_ - new_) > 5, false) ORDER BY pos LIMIT 40""")
def first_flips(spark, d):
    """The report lists the first 40 clips whose cut changed, with the true time beside."""
    old, new = F.get("truth", F.lit(0)), F.get("pred", F.lit(0))
    rows = cut_lists(spark, d).select(F.col("clip").alias("pos"), old.alias("old"), new.alias("new"), F.get("truth", F.lit(1)).alias("true"), match.flipped(old, new, 5.0).alias("flipped"))
    return match.first_flips(rows).select("pos", *[F.round(c, 6).alias(f"{c}_cut") for c in ("old", "new", "true")])


#: Frames a second of the clips of the second stage, which have a frame an event.
FPS = 3.0


def split_sql(source: str, name: str) -> str:
    """The best split of each clip of source (clip, i, flag)."""
    return f"""{name}_0 AS (SELECT *, sum(CASE WHEN flag THEN 1 ELSE -1 END) OVER (PARTITION BY clip ORDER BY i ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY clip ORDER BY i) AS pos FROM {source}),
    {name}_1 AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY s DESC, pos) AS rn, count(*) OVER (PARTITION BY clip) AS n FROM {name}_0),
    {name} AS (SELECT clip, n, CAST(CASE WHEN s <= 0 THEN 0 ELSE pos END AS BIGINT) AS best FROM {name}_1 WHERE rn = 1)"""


def scan_sql(spans: str, name: str, rate: float, least: int, flag: float) -> str:
    """Scores at the centres of equal bins of spans (clip, a, b), and their best split."""
    return f"""{name}_n AS (SELECT *, greatest({least}, CAST(trunc((b - a) * {rate}::DOUBLE) AS BIGINT)) AS bins FROM {spans}),
    {name}_t AS (SELECT clip, k AS i, bins, a + (b - a) * (k + 0.5::DOUBLE) / bins AS t FROM {name}_n, unnest(range(bins)) u(k)),
    {name}_s AS (SELECT q.clip, q.i, q.t, bins, coalesce(sim, 0.0) AS sim, coalesce(sim, 0.0) >= {flag} AS flag FROM {name}_t q JOIN total_ USING (clip)
        LEFT JOIN score_ c ON c.clip = q.clip AND c.idx = least(CAST(trunc(q.t * {FPS}::DOUBLE) AS BIGINT), total - 1)),
    {split_sql(f"{name}_s", f"{name}_b")},
    {name} AS (SELECT s.*, best, greatest(2, bins // 5) AS lead_ FROM {name}_s s JOIN {name}_b USING (clip))"""


def stage_sql(t: str, shots: str) -> str:
    """Decisions {t} (clip, n, cut, method) and scores {t}_l (clip, i, start_, sim) of shots (clip, i, start_, end_)."""
    near = "inner_ >= cut - 2.5 AND inner_ < cut - 0.4"
    return f"""{t}_l AS (SELECT clip, i, any_value(start_) AS start_, any_value(end_) AS end_, median(sim) AS sim, median(sim) >= 0.35 AS flag FROM (
        SELECT s.clip, s.i, start_, end_, coalesce(sim, 0.0) AS sim FROM {shots} s JOIN total_ USING (clip), unnest(range(3)) u(k)
        LEFT JOIN score_ c ON c.clip = s.clip AND c.idx = least(CAST(trunc((start_ + (end_ - start_) * (k + 0.5::DOUBLE) / 3) * {FPS}::DOUBLE) AS BIGINT), total - 1)) GROUP BY clip, i),
    {split_sql(f"{t}_l", f"{t}_b")},
    {t}_p AS (SELECT b.clip, n, best, CASE WHEN n = 1 OR best = n OR best = 0 AND top < 0.15 THEN NULL ELSE greatest(best, 1) END AS at_,
        CASE WHEN (n = 1 OR best = 0) AND top < 0.15 THEN 'all_meme_no_creator' WHEN n = 1 THEN 'single_shot_creator' WHEN best = n THEN 'all_creator_no_transition' WHEN best = 0 THEN 'creator_to_meme_prior' ELSE 'creator_to_meme' END AS method
        FROM {t}_b b JOIN (SELECT clip, max(sim) AS top FROM {t}_l GROUP BY clip) USING (clip)),
    {t}_q AS MATERIALIZED (SELECT p.*, l.start_ AS cut FROM {t}_p p LEFT JOIN {t}_l l ON l.clip = p.clip AND l.i = at_),
    {scan_sql(f"(SELECT clip, 0.0::DOUBLE AS a, total / {FPS}::DOUBLE AS b FROM {t}_q JOIN total_ USING (clip) WHERE cut IS NULL)", f"{t}_w", 4.0, 2, 0.35)},
    {t}_soft AS (SELECT clip, CASE WHEN count(*) FILTER (WHERE i < lead_ AND flag) >= 0.7 * any_value(lead_) AND any_value(best) > 0 AND any_value(best) < any_value(bins)
        AND max(t) - max(t) FILTER (WHERE i = best) >= 1.0 AND avg(CASE WHEN flag THEN 0.0 ELSE 1.0 END) FILTER (WHERE i >= best) >= 0.8 THEN round(max(t) FILTER (WHERE i = best), 3) END AS soft FROM {t}_w GROUP BY clip),
    {scan_sql(f"(SELECT l.clip, start_ AS a, end_ AS b FROM {t}_q q JOIN {t}_l l ON l.clip = q.clip AND l.i = at_ - 1 WHERE end_ - start_ > 0.8)", f"{t}_v", 6.0, 3, 0.45)},
    {t}_in AS (SELECT clip, CASE WHEN avg(sim) FILTER (WHERE i < lead_) >= 0.55 AND any_value(best) > 0 AND any_value(best) < any_value(bins) AND avg(CASE WHEN flag THEN 0.0 ELSE 1.0 END) FILTER (WHERE i >= best) >= 0.6
        AND median(sim) FILTER (WHERE i >= best) < 0.35 THEN round(max(t) FILTER (WHERE i = best), 3) END AS inner_ FROM {t}_v GROUP BY clip),
    {t} AS MATERIALIZED (SELECT clip, n, CASE WHEN cut IS NULL THEN soft WHEN {near} THEN inner_ ELSE cut END AS cut,
        CASE WHEN cut IS NULL AND soft IS NOT NULL THEN 'creator_to_meme_soft' WHEN {near} THEN 'creator_to_meme_softcut' ELSE method END AS method
        FROM {t}_q LEFT JOIN {t}_soft USING (clip) LEFT JOIN {t}_in USING (clip))"""


def _shots_sql(name: str, mark: str) -> str:
    starts = f"SELECT clip, 0.0::DOUBLE AS start_ FROM total_ UNION SELECT clip, i / {FPS}::DOUBLE FROM curve WHERE {mark}"
    return f"{name} AS (SELECT clip, row_number() OVER w - 1 AS i, start_, coalesce(lead(start_) OVER w, total / {FPS}::DOUBLE) AS end_ FROM ({starts}) JOIN total_ USING (clip) WINDOW w AS (PARTITION BY clip ORDER BY start_))"


STAGE = f"""{CURVE}, total_ AS (SELECT clip, count(*) AS total FROM curve GROUP BY clip),
    score_ AS MATERIALIZED (SELECT c.clip, i AS idx, CASE WHEN c.clip % 4 <> 0 THEN sim WHEN i < total // 2 THEN sim * 0.4::DOUBLE + 0.6::DOUBLE ELSE sim * 0.3::DOUBLE END AS sim FROM curve c JOIN total_ USING (clip) WHERE event_type <> 'view'),
    {_shots_sql("shot_1", "event_type = 'purchase' AND clip % 3 <> 0")}, {_shots_sql("shot_2", "event_type = 'signup' AND clip % 2 = 0")},
    {stage_sql("one", "shot_1")}, {stage_sql("two", "(SELECT s.* FROM shot_2 s JOIN one o USING (clip) WHERE o.n = 1 AND o.cut IS NULL)")},
    decided AS (SELECT * FROM one WHERE clip NOT IN (SELECT clip FROM two WHERE n > 1) UNION ALL SELECT * FROM two WHERE n > 1),
    labelled AS (SELECT l.*, CASE WHEN CASE method WHEN 'creator_to_meme_prior' THEN start_ < cut - 1e-6 WHEN 'single_shot_creator' THEN true WHEN 'all_creator_no_transition' THEN true ELSE flag END THEN 'person' ELSE 'meme' END AS label
        FROM (SELECT * FROM one_l WHERE clip NOT IN (SELECT clip FROM two WHERE n > 1) UNION ALL SELECT * FROM two_l WHERE clip IN (SELECT clip FROM two WHERE n > 1)) l JOIN decided USING (clip))"""


def stage_inputs(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(shots, clips, scores, shots of a second detection): a frame an event, purchases and signups as shot boundaries."""
    c = keep(curve(spark, d))
    clips = c.groupBy("clip").agg(F.count("*").alias("total")).withColumn("fps", F.lit(FPS))
    early = F.col("i") < F.expr("total div 2")
    sim = F.when(F.col("clip") % 4 != 0, F.col("sim")).when(early, F.col("sim") * 0.4 + 0.6).otherwise(F.col("sim") * 0.3)
    scores = c.filter("event_type <> 'view'").join(clips, "clip").select("clip", F.col("i").alias("idx"), sim.alias("sim"))

    def shots_at(marks: DataFrame) -> DataFrame:
        starts = clips.select("clip", F.lit(0.0).alias("start")).union(marks.select("clip", F.col("i") / FPS)).distinct().join(clips, "clip")
        w = Window.partitionBy("clip").orderBy("start")
        return starts.select("clip", (F.row_number().over(w) - 1).alias("i"), "start", F.coalesce(F.lead("start").over(w), F.col("total") / FPS).alias("end"))

    return shots_at(c.filter("event_type = 'purchase' and clip % 3 <> 0")), clips, scores, shots_at(c.filter("event_type = 'signup' and clip % 2 = 0"))


@query(f"WITH {STAGE} SELECT clip, n, round(cut, 3) AS cut, method FROM decided")
def base_decisions(spark, d):
    """The second stage: the pick, a gradual cut where there is none, one inside the shot before it, and a second detection of single shots."""
    shots_1, clips, scores, shots_2 = stage_inputs(spark, d)
    return relabel.relabel(shots_1, clips, scores, shots_2)[1]


@query(f"WITH {STAGE} SELECT clip, i, round(start_, 6) AS start, round(sim, 6) AS sim, label FROM labelled")
def relabelled_shots(spark, d):
    """The shots that the second stage settles on, with their labels."""
    shots_1, clips, scores, shots_2 = stage_inputs(spark, d)
    s = relabel.relabel(shots_1, clips, scores, shots_2)[0]
    return s.select("clip", "i", F.round("start", 6).alias("start"), F.round("sim", 6).alias("sim"), "label")


@query(f"""WITH {CURVE}, n AS (SELECT clip, dur, rate, greatest(2, CAST(trunc(dur * rate) AS BIGINT)) AS n FROM dur, (VALUES (0.05::DOUBLE), (0.08::DOUBLE)) v(rate)),
    s AS (SELECT clip, rate, k, dur * (k + 0.5::DOUBLE) / n AS at_ FROM n, unnest(range(n)) u(k)),
    j AS (SELECT s.clip, rate, k, i, t, sim, event_type, row_number() OVER (PARTITION BY s.clip, rate, k ORDER BY abs(t - at_), t, i) AS rn FROM s JOIN curve c ON s.clip = c.clip)
    SELECT clip, CASE WHEN rate = 0.05::DOUBLE THEN 'sim' ELSE 'luma' END AS kind, k AS i, round(t, 3) AS t, CASE WHEN rate = 0.05::DOUBLE THEN CASE WHEN event_type <> 'view' THEN round(sim, 4) ELSE 0.0 END ELSE ((i + clip) * 37 % 256)::DOUBLE END AS value FROM j WHERE rn = 1""")
def dense_curves(spark, d):
    """Similarity and luma, each sampled evenly in real time; frames without a face have similarity 0."""
    c = keep(curve(spark, d))
    frames = c.select("clip", F.col("i").alias("idx"), F.col("t").alias("pts"))
    sims = series.dense_curve(durations(c), frames, c.filter("event_type <> 'view'").select("clip", F.col("i").alias("idx"), F.col("sim").alias("v")), 0.05)
    lumas = series.dense_curve(durations(c), frames, luma_of(c).select("clip", F.col("i").alias("idx"), F.col("luma").alias("v")), 0.08, 2)
    return sims.withColumn("kind", F.lit("sim")).unionByName(lumas.withColumn("kind", F.lit("luma"))).select("clip", "kind", "i", "t", F.col("sim").alias("value"))


@query(f"""WITH rec AS (SELECT doc_id AS clip, doc_id AS pos, CASE WHEN n_chars % 4 <> 0 THEN (n_chars % 1000) / 100.0::DOUBLE END AS cut FROM documents), gt AS (SELECT doc_id AS clip, toxic = 1 AS edited FROM labels WHERE doc_id % 4 <> 1),
    s AS (SELECT conv_id AS clip, count(*) AS n, max(turn) * 2.5::DOUBLE AS last FROM conversations GROUP BY conv_id), v AS (SELECT doc_id AS clip, CASE WHEN quality = 1 THEN 'correct' ELSE 'missed' END AS verdict FROM labels WHERE doc_id % 2 = 0),
    j AS (SELECT rec.*, edited, verdict, coalesce(n, 1) AS n_shots, greatest(coalesce(last, 1.0), 1.0) AS dur FROM rec LEFT JOIN gt USING (clip) LEFT JOIN s USING (clip) LEFT JOIN v USING (clip)), k AS (SELECT *, {CATEGORY} AS category FROM j)
    SELECT clip, cut, n_shots AS n_segments, dur, round(cut / dur * 100, 6) AS percent, category, row_number() OVER (ORDER BY CASE category WHEN 'unlabeled' THEN 0 WHEN 'problem' THEN 1 WHEN 'none' THEN 2 WHEN 'multicut' THEN 3 ELSE 4 END, cut ASC NULLS LAST, pos) AS place FROM k""")
def workbench_rows(spark, d):
    """Records left join truth left join segments left join verdicts, in the order of the workbench."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    records = docs.select(F.col("doc_id").alias("clip"), F.col("doc_id").alias("pos"), F.when(F.col("n_chars") % 4 != 0, (F.col("n_chars") % 1000) / 100.0).alias("cut"))
    gt = labels.filter("doc_id % 4 <> 1").select(F.col("doc_id").alias("clip"), (F.col("toxic") == 1).alias("edited"))
    seg = table(spark, d, "conversations").select(F.col("conv_id").alias("clip"), (F.col("turn") * 2.5).alias("end"))
    ver = labels.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("clip"), F.when(F.col("quality") == 1, "correct").otherwise("missed").alias("verdict"))
    w = report.placed(report.workbench(records, gt, seg, ver), report.rank_of(F.col("category"), report.CATEGORIES), F.col("cut").asc_nulls_last(), "pos")
    return w.select("clip", "cut", "n_segments", F.col("dur").cast("double").alias("dur"), F.round("percent", 6).alias("percent"), "category", "place")


@query(f"""WITH {CURVE}, e AS (SELECT clip, greatest(round(t - 20, 3), 0.0) AS sec FROM curve WHERE event_type = 'click' AND clip % 3 <> 0), g AS (SELECT clip, sec, sec - lag(sec) OVER (PARTITION BY clip ORDER BY sec) AS gap FROM e),
    k AS (SELECT clip, list(sec ORDER BY sec) AS cuts FROM g WHERE gap IS NULL OR gap > 0.0005 GROUP BY clip)
    SELECT dur.clip, coalesce(len(cuts), 0) AS n, cuts[1] AS cut_sec, coalesce(len(cuts), 0) > 0 AS has_transition, coalesce(len(cuts), 0) >= 2 AS returns FROM dur LEFT JOIN k USING (clip)""")
def cut_fields(spark, d):
    c = keep(curve(spark, d))
    events = truth.normalise_events(c.filter("event_type = 'click' and clip % 3 <> 0").select("clip", (F.col("t") - 20).alias("sec")))
    return truth.with_cut_fields(c.select("clip").distinct(), events).select("clip", F.size("cuts").alias("n"), "cut_sec", "has_transition", "returns")


@query(f"WITH {REVIEW} SELECT count(CASE WHEN coalesce(edited, false) THEN 1 END) AS kept, count(CASE WHEN NOT coalesce(edited, false) THEN 1 END) AS cleared, count(*) AS total FROM rv")
def blanking_counts(spark, d):
    return truth.blanking_counts(review(spark, d))


@query(f"""WITH {REVIEW} SELECT count(*) AS "all", count(CASE WHEN NOT coalesce(edited, false) THEN 1 END) AS unedited, count(CASE WHEN coalesce(edited, false) THEN 1 END) AS edited, count(CASE WHEN cut IS NULL THEN 1 END) AS no_cut, count(CASE WHEN n_shots = 5 THEN 1 END) AS differs FROM rv""")
def filter_counts(spark, d):
    r = review(spark, d).withColumn("cuts", F.when(F.col("cut").isNotNull(), F.array("cut"))).withColumn("differs", F.col("n_shots") == 5)
    return truth.filter_counts(r)


@query("""WITH c AS (SELECT page_id, concat('c<', page_id, '>.mp4') AS clip, CASE page_id % 3 WHEN 0 THEN 'problem' WHEN 1 THEN 'none' ELSE 'clean' END AS section, CASE page_id % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'close' WHEN 2 THEN 'missed' END AS verdict,
        CASE WHEN page_id % 5 <> 0 THEN page_id * 0.37::DOUBLE END AS cut, CASE WHEN page_id % 2 = 0 THEN url END AS notes FROM pages)
    SELECT replace(replace(clip, '<', '&lt;'), '>', '&gt;') AS title, section, CASE WHEN page_id % 7 < 5 THEN concat('thumbs/c<', page_id, '>_', section, '.jpg') END AS thumbnail, CASE WHEN cut IS NULL THEN 'none' ELSE printf('%.2fs', cut) END AS cut_text,
        replace(replace(replace(replace(coalesce(notes, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS notes_html, CASE WHEN verdict = 'correct' THEN 'green' WHEN verdict = 'close' THEN 'amber' ELSE 'red' END AS colour FROM c""")
def report_cards(spark, d):
    """Cards of a report, with the thumbnail that goes with the clip and its section, if there is one."""
    of = lambda c, *names: F.when(c == 0, names[0]).when(c == 1, names[1]).when(c == 2, names[2]).otherwise(names[3])
    p = F.col("page_id")
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("c<"), p.cast("string"), F.lit(">.mp4")).alias("clip"), of(p % 3, "problem", "none", "clean", None).alias("section"), of(p % 4, "correct", "close", "missed", None).alias("verdict"),
                                           F.when(p % 5 != 0, p * 0.37).alias("cut"), F.when(p % 2 == 0, F.col("url")).alias("notes"))
    files = rows.filter("page_id % 7 < 5").select(F.concat(F.lit("thumbs/c<"), p.cast("string"), F.lit(">_"), "section", F.lit(".jpg")).alias("path"))
    return report.cards(rows, files).select("title", "section", "thumbnail", "cut_text", "notes_html", "colour")


@query(SEGMENTS + """ SELECT clip, seg_idx, concat('segments/u', clip, '/', printf('%02d_%s.mp4', CAST(seg_idx + 1 AS INTEGER), CASE state WHEN 0 THEN 'person' ELSE 'meme' END)) AS file, round(start_, 6) AS start, round(greatest(0.05, end_ - start_), 6) AS dur FROM seg""")
def clip_video_plan(spark, d):
    s = keep(segments(spark, d).withColumn("label", F.when(F.col("state") == 0, "person").otherwise("meme")))
    clips = s.select("clip").distinct().withColumn("name", F.concat(F.lit("u"), F.col("clip").cast("string"), F.lit(".mp4")))
    return report.clip_video_plan(s, clips).select("clip", "seg_idx", "file", F.round("start", 6).alias("start"), F.round("dur", 6).alias("dur"))


@query("""SELECT c.conv_id AS clip, c.n FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c WHERE conv_id % 4 <> 3 AND conv_id % 5 <> 0 AND EXISTS (SELECT 1 FROM documents WHERE doc_id = conv_id AND doc_id % 3 <> 0)""")
def usable_records(spark, d):
    """Records with shots and without an error, whose file is there."""
    s = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("clip")).agg(F.collect_list("turn").alias("all_"))
    records = s.select("clip", F.size("all_").alias("n"), F.when(F.col("clip") % 4 != 3, F.col("all_")).alias("shots"), F.when(F.col("clip") % 5 == 0, "no frames").alias("error"))
    files = table(spark, d, "documents").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("name"))
    return documents.usable(records, files).select("clip", "n")


@query("""WITH x AS (SELECT doc_id, n_chars % 90 AS f, (n_chars % 7) / 2.0::DOUBLE AS s, n_chars / 16.0::DOUBLE AS now FROM documents), y AS (SELECT *, coalesce(CASE WHEN f <> 0 THEN f::DOUBLE END / CASE WHEN s <> 0 THEN s END, 30.0) AS fps FROM x)
    SELECT doc_id, round(fps, 6) AS fps, CAST(floor(now * 25.0::DOUBLE + 0.5) AS BIGINT) AS frame, least(greatest(now - 10, 0.0), 60.0) AS seek FROM y""")
def playhead(spark, d):
    x = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 90).alias("f"), ((F.col("n_chars") % 7) / 2.0).alias("s"), (F.col("n_chars") / 16.0).alias("now"))
    return x.select("doc_id", F.round(X.frames_per_second(F.col("f"), F.col("s")), 6).alias("fps"), X.frame_number(F.col("now"), F.lit(25.0)).alias("frame"), X.clamp(F.col("now") - 10, F.lit(0.0), F.lit(60.0)).alias("seek"))


@query(f"""WITH {CURVE}, m AS (SELECT clip, t AS mt FROM curve WHERE event_type = 'purchase') SELECT c.i, round(c.t, 6) AS t, repeat('#', CAST(trunc(c.sim * 40) AS INTEGER)) AS bar, count(mt) AS marks
    FROM curve c LEFT JOIN m ON m.clip = c.clip AND abs(mt - c.t) < 6 WHERE c.clip = 3 GROUP BY c.i, c.t, c.sim""")
def inspect_clip(spark, d):
    """One clip's curve, with the marks near each sample; which clip is the question asked."""
    c = keep(curve(spark, d))
    marks = c.filter("event_type = 'purchase'").select("clip", "t", F.lit("gt").alias("kind"))
    return place.inspect(c, marks, 3, 6.0).select("i", F.round("t", 6).alias("t"), "bar", F.size("marks").alias("marks"))


@query("SELECT doc_id AS clip FROM labels WHERE toxic = 1")
def bad_clips(spark, d):
    return report.bad_clips(table(spark, d, "labels").select(F.col("doc_id").alias("clip"), F.when(F.col("toxic") == 1, "bad").otherwise("ok").alias("flag")))


@query("""WITH f AS (SELECT conv_id, turn, CASE length(text) % 3 WHEN 0 THEN 'ok' ELSE 'bad' END AS flag FROM conversations),
    r AS (SELECT *, sum(CASE WHEN flag = prev THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, lag(flag) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM f)),
    n AS (SELECT conv_id, run, flag, count(*) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY run DESC) AS rn FROM r GROUP BY conv_id, run, flag)
    SELECT conv_id AS clip, CASE WHEN n % 2 = 1 THEN flag END AS flag FROM n WHERE rn = 1""")
def flag_toggles(spark, d):
    flag = F.when(F.length("text") % 3 == 0, "ok").otherwise("bad")
    return truth.latest_flags(table(spark, d, "conversations").select(F.col("conv_id").alias("clip"), F.col("turn").alias("pos"), flag.alias("flag")))


@query("""WITH fr AS (SELECT o_custkey AS clip, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, o_orderkey FROM orders),
    fa AS (SELECT clip, idx, l_linenumber AS no, l_quantity AS side, CASE WHEN l_linenumber % 7 <> 6 THEN l_discount * 10 ELSE 0.0 END AS sim FROM fr JOIN lineitem ON l_orderkey = o_orderkey WHERE idx % 2 = 0),
    seen AS (SELECT clip, idx, count(*) AS n, max(sim) AS best, string_agg(CASE WHEN sim >= 0.35 THEN 'green' WHEN sim >= 0.25 THEN 'yellow' ELSE 'red' END, ',' ORDER BY no, side, sim) AS colours FROM fa GROUP BY clip, idx),
    held AS (SELECT fr.clip, fr.idx, fr.idx / 25.0::DOUBLE AS t, coalesce(n, 0) AS n_boxes, greatest(coalesce(best, 0.0), 0.0) AS best, coalesce(colours, '') AS colours FROM fr LEFT JOIN seen ON seen.clip = fr.clip AND seen.idx = fr.idx - fr.idx % 2)
    SELECT clip, idx, round(t, 6) AS t, n_boxes, round(best, 6) AS best, colours, CASE WHEN best >= 0.35 THEN 'CREATOR' ELSE 'meme' END AS label,
        concat('t=', printf('%.2f', t), 's  max=', printf('%.2f', best), '  thr=0.35  -> ', CASE WHEN best >= 0.35 THEN 'CREATOR' ELSE 'meme' END) AS caption FROM held""")
def debug_overlay(spark, d):
    """Boxes, colours and the caption of every frame: a customer's orders as frames, their lines as faces, some without a similarity."""
    w = Window.partitionBy("clip").orderBy("o_orderkey")
    frames = table(spark, d, "orders").select(F.col("o_custkey").alias("clip"), "o_orderkey").withColumn("idx", F.row_number().over(w) - 1).withColumn("fps", F.lit(None).cast("double"))
    lines = table(spark, d, "lineitem").join(frames, F.col("l_orderkey") == F.col("o_orderkey"))
    faces = lines.select("clip", "idx", F.col("l_linenumber").alias("face_no"), F.array("l_quantity").alias("bbox"), F.when(F.col("l_linenumber") % 7 != 6, F.col("l_discount") * 10).alias("sim"))
    o = identity.overlay(frames, faces)
    return o.select("clip", "idx", F.round("t", 6).alias("t"), F.size("boxes").alias("n_boxes"), F.round("best", 6).alias("best"), F.array_join("boxes.colour", ",").alias("colours"), "label", "caption")


# Every step of a clip's edits is a step of the recursion; ``raw`` is the list that an edit makes, before it is normalised.
EDITED = """ops AS (SELECT conv_id AS clip, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, CASE length(text) % 11 % 8 WHEN 0 THEN 'add' WHEN 1 THEN 'nudge' WHEN 2 THEN 'remove' WHEN 3 THEN 'set'
        WHEN 4 THEN 'pattern' WHEN 5 THEN 'copy' WHEN 6 THEN 'clear' ELSE 'reset' END AS op, turn % 3 + 1 AS at_, CAST(length(text) % 50 AS DOUBLE) AS val, CASE WHEN turn % 2 = 0 THEN 'all meme' ELSE 'person->meme' END AS name FROM conversations),
step AS (SELECT clip, CAST(0 AS BIGINT) AS k, truth AS cuts, false AS edited, 'person->meme' AS pattern, CASE WHEN clip % 2 = 0 THEN pred[1] END AS ref FROM lists
    UNION ALL SELECT clip, k, cuts, edited, CASE WHEN op = 'pattern' THEN name WHEN op IN ('add', 'remove', 'clear', 'copy') AND NOT idle THEN CASE WHEN len(cuts) = 1 THEN 'person->meme' WHEN len(cuts) = 2 THEN 'person->meme->person'
            WHEN len(cuts) > 2 THEN 'person->meme->person->meme' WHEN pattern LIKE 'all%' THEN pattern ELSE '' END ELSE pattern END AS pattern, ref
        FROM (SELECT clip, k, op, name, idle, pattern, ref, CASE WHEN op = 'reset' THEN false ELSE edited OR NOT idle END AS edited,
                CASE WHEN idle OR raw IS NULL THEN cuts ELSE [sorted_[j] FOR j IN range(1, len(sorted_) + 1) IF j = 1 OR sorted_[j] - sorted_[j - 1] > 0.0005] END AS cuts
            FROM (SELECT *, list_sort([greatest(round(x, 3), 0.0::DOUBLE) FOR x IN raw]) AS sorted_
                FROM (SELECT s.clip, o.k, o.op, o.name, s.cuts, s.edited, s.pattern, s.ref, o.op IN ('nudge', 'set', 'remove') AND at_ > len(cuts) AS idle,
                        CASE o.op WHEN 'add' THEN list_append(cuts, val) WHEN 'nudge' THEN list_append(cuts[:at_ - 1], cuts[at_] + val) || cuts[at_ + 1:] WHEN 'set' THEN list_append(cuts[:at_ - 1], val) || cuts[at_ + 1:]
                            WHEN 'remove' THEN cuts[:at_ - 1] || cuts[at_ + 1:] WHEN 'copy' THEN CASE WHEN ref IS NULL THEN CAST([] AS DOUBLE[]) ELSE [ref] END WHEN 'clear' THEN CAST([] AS DOUBLE[])
                            WHEN 'pattern' THEN CASE WHEN name LIKE 'all%' THEN CAST([] AS DOUBLE[]) END END AS raw
                    FROM step s JOIN ops o ON o.clip = s.clip AND o.k = s.k + 1))))"""


@query(f"WITH RECURSIVE {CURVE}, {LISTS}, {EDITED} SELECT clip, edited, pattern, len(cuts) AS n, round(coalesce(list_sum(cuts), 0.0), 3) AS cut_sum FROM step QUALIFY row_number() OVER (PARTITION BY clip ORDER BY k DESC) = 1")
def apply_edits(spark, d):
    """Ordered edits of hand labels, folded in the clip's own list."""
    lists = cut_lists(spark, d).select("clip", F.col("truth").alias("cuts"), F.lit(False).alias("edited"), F.lit("person->meme").alias("pattern"), F.when(F.col("clip") % 2 == 0, F.get("pred", F.lit(0))).alias("reference"))
    ops = ["add", "nudge", "remove", "set", "pattern", "copy", "clear", "reset"]
    op = F.element_at(F.array(*map(F.lit, ops)), (F.length("text") % 11 % 8 + 1).cast("int"))
    edits = table(spark, d, "conversations").select(F.col("conv_id").alias("clip"), F.col("turn").alias("pos"), op.alias("op"), (F.col("turn") % 3).alias("index"), (F.length("text") % 50).cast("double").alias("value"), F.when(F.col("turn") % 2 == 0, "all meme").otherwise("person->meme").alias("text"))
    out = truth.apply_edits(lists, edits)
    return out.select("clip", "edited", "pattern", F.size("cuts").alias("n"), F.round(F.aggregate("cuts", F.lit(0.0), lambda a, x: a + x), 3).alias("cut_sum"))
