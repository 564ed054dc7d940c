import json
import random

import pytest
from cutlab.functions import text as X
from cutlab.operators import identity, match, place, report, truth
from cutlab.sources import documents
from pyspark.sql import functions as F


def greedy(gts, preds, tol):
    pool, errors = list(preds), []
    for g in gts:
        if pool:
            k = min(range(len(pool)), key=lambda i: abs(pool[i] - g))
            if abs(pool[k] - g) <= tol:
                errors.append(abs(pool.pop(k) - g))
    return errors, len(gts) - len(errors), len(pool)


def test_greedy_match_equals_the_loop(spark):
    rng = random.Random(1)
    data = [(k, [round(rng.uniform(0, 9), 1) for _ in range(rng.randrange(5))], [round(rng.uniform(0, 9), 1) for _ in range(rng.randrange(5))]) for k in range(300)]
    data += [(300, [1.0, 1.4], [1.2, 0.9]), (301, [2.0], [1.5, 2.5]), (302, [], []), (303, None, [1.0])]
    df = spark.createDataFrame(data, "clip int, truth array<double>, pred array<double>")
    for r in match.with_verdict(match.greedy_match(df, 0.5)).collect():
        g, p = r.truth or [], r.pred or []
        errors, missed, extra = greedy(g, p, 0.5)
        assert (r.errors, r.missed, r.extra, r.tp) == (errors, missed, extra, len(errors))
        want = ("correct_none" if not extra else "false_positive") if not g else "missed" if not errors else "correct" if not missed and not extra else "partial"
        assert r.verdict == want


def test_totals_without_events_are_100_percent(spark):
    df = spark.createDataFrame([(1, [], [])], "clip int, truth array<double>, pred array<double>")
    t = match.totals(match.greedy_match(df, 0.5)).first()
    assert (t.precision, t.recall, t.full, t.mean_error) == (100.0, 100.0, 1, None)


def test_normalised_events(spark):
    secs = [3.0, 1.0, 1.0005, 1.0012, -2.0, None, float("nan"), 3.0]
    df = spark.createDataFrame([("a", s) for s in secs], "clip string, sec double")
    got = [(r.k, r.sec, r.to) for r in truth.normalise_events(df).orderBy("k").collect()]
    assert [g[0] for g in got] == list(range(len(got))) and got[0] == (0, 0.0, "meme") and got[-1][1] == 3.0
    again = truth.normalise_events(truth.normalise_events(df).select("clip", "sec"))
    assert [(r.k, r.sec, r.to) for r in again.orderBy("k").collect()] == got


def test_merge_takes_a_whole_row_then_falls_back_per_field(spark):
    base = spark.createDataFrame([(k,) for k in range(4)], "id int")
    s = "id int, a int, b int"
    out = truth.merge_sources(base, spark.createDataFrame([(0, None, 1)], s), spark.createDataFrame([(0, 5, 5), (1, 6, None)], s), spark.createDataFrame([(0, 7, 7), (1, 8, 8), (2, 9, None)], s), "id", ["a", "b"])
    assert {r.id: (r.a, r.b, r.label_source) for r in out.collect()} == {0: (7, 1, "local"), 1: (6, 8, "second"), 2: (9, None, "third"), 3: (None, None, "none")}


def edited_by_hand(cuts, ops, reference):
    cuts, edited, pattern = list(cuts or []), False, "all meme"
    tidy = lambda c: [x for k, x in enumerate(s) if k == 0 or x - s[k - 1] > 0.0005] if (s := sorted(max(0.0, round(x, 3)) for x in c)) else []
    for op, i, value, text in ops:
        there = i is not None and 0 <= i < len(cuts)
        if op == "reset":
            edited = False
        elif op == "pattern":
            cuts, pattern, edited = [] if text.startswith("all") else cuts, text, True
        elif op in ("add", "clear", "copy") or (there and (op == "remove" or (op == "set" and value is None))):
            cuts = {"add": lambda: tidy([*cuts, value]), "clear": list, "copy": lambda: [] if reference is None else [reference]}.get(op, lambda: cuts[:i] + cuts[i + 1 :])()
            pattern = ["", "person->meme", "person->meme->person", "person->meme->person->meme"][min(3, len(cuts))] if cuts or not pattern.startswith("all") else pattern
            edited = True
        elif there:
            cuts, edited = tidy(cuts[:i] + [value + (cuts[i] if op == "nudge" else 0)] + cuts[i + 1 :]), True
    return cuts, edited, pattern


def test_edits(spark):
    rng = random.Random(12)
    names = ["add", "nudge", "set", "remove", "clear", "pattern", "copy", "reset"]
    clips = {f"c{k}": ([round(rng.random() * 9, 3) for _ in range(0)] or None if k % 5 == 0 else sorted(round(rng.random() * 9, 3) for _ in range(k % 4)), rng.choice([None, 2.5])) for k in range(30)}
    ops = {c: [(rng.choice(names), rng.choice([None, 0, 1, 2, 7]), rng.choice([None, -1.0, 0.001, 1.5, 4.25]), rng.choice(["all person", "person->meme"])) for _ in range(rng.randrange(0, 7))] for c in clips}
    ops = {c: [(o, i, 1.25 if o in ("add", "nudge") and v is None else v, t) for o, i, v, t in rows] for c, rows in ops.items()} | {"z": [("add", None, 1.0, "x")]}
    df = spark.createDataFrame([(c, cuts, False, "all meme", ref) for c, (cuts, ref) in clips.items()], "clip string, cuts array<double>, edited boolean, pattern string, reference double")
    edits = spark.createDataFrame([(c, k, *o) for c, rows in ops.items() for k, o in enumerate(rows)], "clip string, pos int, op string, index int, value double, text string").repartition(3)
    got = {r.clip: (r.cuts, r.edited, r.pattern) for r in truth.apply_edits(df, edits).collect()}
    assert got == {c: edited_by_hand(cuts, ops[c], ref) for c, (cuts, ref) in clips.items()}


def test_edits_of_nulls_and_of_nothing(spark):
    schema = "clip string, cuts array<double>, edited boolean, pattern string, reference double"
    df = spark.createDataFrame([("a", None, None, None, None), ("b", [1.0], True, "p", float("nan")), (None, [2.0], False, "p", 1.0), ("c", [3.0], False, "p", 1.0)], schema)
    rows = [("a", 0, "add", None, None, None), ("a", 1, None, None, None, None), ("b", 0, "add", None, float("nan"), None), ("b", 1, "copy", None, None, None), ("b", 2, "pattern", None, None, None), (None, 0, "clear", None, None, None), ("z", 0, "clear", None, None, None)]
    edits = spark.createDataFrame(rows, "clip string, pos int, op string, index int, value double, text string")
    got = {r.clip: (r.cuts, r.edited, r.pattern) for r in truth.apply_edits(df, edits).collect()}
    assert got == {"a": ([], True, ""), "b": ([], True, ""), None: ([2.0], False, "p"), "c": ([3.0], False, "p")}
    assert truth.apply_edits(df.limit(0), edits).count() == 0 and truth.apply_edits(df, edits.limit(0)).count() == 4
    # Equal places go by op and value, whatever the order of rows.
    ties = [("c", 0, "add", None, v, None) for v in (9.0, 3.0004, 5.0)] + [("c", 0, "add", None, 5.0, None)]
    assert truth.apply_edits(df, spark.createDataFrame(ties, edits.schema)).filter("clip = 'c'").first().cuts == [3.0, 5.0, 9.0]


def test_flags_toggle(spark):
    t = [("a", 0, "ok"), ("a", 1, "ok"), ("b", 0, "ok"), ("b", 1, "bad"), ("c", 0, "ok"), ("c", 1, "ok"), ("c", 2, "ok")]
    got = {r.clip: r.flag for r in truth.latest_flags(spark.createDataFrame(t, "clip string, pos int, flag string")).collect()}
    assert got == {"a": None, "b": "bad", "c": "ok"}


def test_differs_and_blanking(spark):
    df = spark.createDataFrame([(True, True, 1.0, 1.04), (True, True, 1.0, 1.2), (True, False, 1.0, 1.0), (None, True, 1.0, 9.0)], "edited boolean, has boolean, cut double, ref double")
    assert [r[0] for r in df.select(truth.differs(F.col("edited"), F.col("has"), F.col("cut"), F.col("ref"))).collect()] == [False, True, True, False]
    b = truth.blank_unedited(df, {"cut": F.lit(None)})
    assert [r.cut for r in b.collect()] == [1.0, 1.0, 1.0, None] and truth.blank_unedited(b, {"cut": F.lit(None)}).collect() == b.collect()


def test_snap_and_return_windows(spark):
    b = spark.createDataFrame([("a", 10.0), ("b", 1.0)], "clip string, b double")
    cuts = spark.createDataFrame([("a", 9.2), ("a", 10.3), ("a", 9.65)], "clip string, t double")
    got = {r.clip: (r.near_cut, r.return_cut) for r in place.snap_times(b, cuts).collect()}
    assert got == {"a": (10.3, 10.3), "b": (None, None)}
    edge = spark.createDataFrame([("a", 9.2)], "clip string, t double")
    assert place.snap_times(b, edge, 0.35, 0.8000000001).filter("clip = 'a'").first().return_cut == 9.2


def test_fade(spark):
    curve = spark.createDataFrame([("a", i, i * 0.1, 0.0) for i in range(20)], "clip string, i int, t double, sim double")
    def run(lumas):
        luma = spark.createDataFrame([("a", i, i * 0.1, v) for i, v in enumerate(lumas)], "clip string, i int, t double, luma double")
        r = place.fade_times(spark.createDataFrame([("a", 0.5)], "clip string, b double"), luma, curve).first()
        return r and r.fade
    assert run([100.0, 90.0, 75.0, 60.0, 48.0, 48.0, 70.0, 90.0, 100.0, 110.0, 110.0]) == 0.4
    assert run([100.0, 100.0, 100.0, 60.0, 48.0, 82.1, 90.0, 90.0, 90.0, 90.0, 90.0]) is None
    assert run([150.0, 170.0, 190.0, 200.0, 212.0, 212.0, 200.0, 190.0, 190.0, 190.0, 190.0]) == 0.4


def test_centroid_trims_outliers_and_keeps_small_groups(spark):
    good = [("a", [1.0, 0.1 * k, 0.0]) for k in range(6)] + [("a", [-1.0, 0.0, 0.0]), ("a", [0.0, 0.0, 0.0])]
    few = [("b", [1.0, 0.0, 0.0]), ("b", [-1.0, 0.2, 0.0])]
    c = {r.g: r for r in identity.trimmed_centroid(spark.createDataFrame(good + few, "g string, embedding array<double>"), ["g"]).collect()}
    assert c["a"].n == 8 and c["a"].n_inliers == 6 and c["b"].n == 2
    assert identity.trimmed_centroid(spark.createDataFrame([], "g string, embedding array<double>"), ["g"]).count() == 0


def test_split_plan(spark):
    seg = spark.createDataFrame([("a", 0, 0.0, 1.0, "person"), ("a", 1, 1.0, 2.0, "meme"), ("a", 2, 2.0, 3.0, "person"), ("b", 0, 0.0, 5.0, "meme"), ("m", 0, 0.0, 1.0, "meme"), ("m", 1, 1.0, 2.0, "person")], "clip string, seg_idx int, start double, end double, label string")
    clips = spark.createDataFrame([("a", "a.MP4", True), ("b", "b.mp4", True), ("m", "m.mp4", False), ("n", "n.mp4", True)], "clip string, name string, exists boolean")
    plan = report.split_plan(seg, clips)
    got = sorted((r.clip, r.disposition, r.file or "", r.mode or "") for r in plan.collect())
    assert got == [("a", "multi_3seg", "split/meme/a_meme_1.mp4", "cut"), ("a", "multi_3seg", "split/person/a_person_1.mp4", "cut"), ("a", "multi_3seg", "split/person/a_person_2.mp4", "cut"), ("b", "single_segment", "split/meme/b_meme_1.mp4", "copy"), ("m", "skip_missing_src", "", ""), ("n", "skip_no_segments", "", "")]
    records = spark.createDataFrame([(c, c * 2, "p", k) for c, k in (("a", 3), ("b", 1), ("m", 2), ("n", None))], "clip string, short string, pattern string, n_segments int")
    m = {r.clip: r for r in report.manifest(plan, records).collect()}
    assert {c: (r.short, r.n_segments, r.disposition, len(r.outputs)) for c, r in m.items()} == {"a": ("aa", 3, "multi_3seg", 3), "b": ("bb", 1, "single_segment", 1), "m": ("mm", 2, "skip_missing_src", 0), "n": ("nn", 0, "skip_no_segments", 0)}
    assert tuple(m["a"].outputs[1]) == ("meme", 1, "a_meme_1.mp4", 1.0, 2.0, 1.0, "cut")


def test_names_and_formats(spark):
    df = spark.createDataFrame([("abcdefghijklmnop.mp4",), ("abcdefghijklmnop.mov",), ("x.MP4",), ("noext",)], "n string")
    got = [tuple(r) for r in df.select(X.short_id(F.col("n")), X.stem(F.col("n"))).collect()]
    assert got == [("efghijklmnop", "abcdefghijklmnop"), ("abcdefghijklmnop.mov", "abcdefghijklmnop"), ("x.MP4", "x"), ("noext", "noext")]
    one = spark.range(1).select(X.seconds(F.lit(None).cast("double")), X.seconds(F.lit(1.5)), X.url_path(F.lit("a b/ü")), X.frames_per_second(F.lit(0), F.lit(2.0)), X.seconds_list(F.array().cast("array<double>"))).first()
    assert tuple(one) == ("none", "1.50s", "a%20b%2F%C3%BC", 30.0, "—")


def test_documents(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"by_clip": {"a": {"s": "a", "true_sec": 2, "verdict": "correct"}, "b": {"s": "b", "true_sec": null, "verdict": "missed"}}}')
    rows = documents.read_map(spark, str(tmp_path / "v.json"), documents.VERDICT, "by_clip").collect()
    assert {r.key: (r.true_sec, r.verdict) for r in rows} == {"a": (2.0, "correct"), "b": (None, "missed")}
    (tmp_path / "g.json").write_text('{"source": "x", "clips": [{"clip": "a.mp4", "short": "a", "cut_sec": 1.0}, {"clip": "a.mp4", "short": "a", "cut_sec": 2.0}]}')
    assert [r.cut_sec for r in documents.read_truth(spark, str(tmp_path / "g.json")).collect()] == [2.0]
    assert documents.optional(spark, lambda: documents.read_rows(spark, str(tmp_path / "no.json"), documents.SEGMENTS), documents.SEGMENTS).count() == 0
    with pytest.raises(FileNotFoundError, match="run it first"):
        documents.required(lambda: documents.read_rows(spark, str(tmp_path / "no.json"), documents.SEGMENTS), "run it first")
    with pytest.raises(PermissionError):
        documents.save_truth(spark.range(1), str(tmp_path), "../evil.json")
    first, second = spark.createDataFrame([(1,)], "n int"), spark.createDataFrame([(2,)], "n int")
    place = documents.save_truth(first, str(tmp_path), "ground_truth.json")
    documents.save_truth(second, str(tmp_path), "ground_truth.json")
    documents.save_truth(first, str(tmp_path), "ground_truth.json")
    assert json.loads(open(place).read()) == {"n": 1} and json.loads(open(place + ".bak").read()) == {"n": 1}
    named = spark.createDataFrame([("a", 1.5), ("b", None)], "short string, x double")
    assert json.loads(open(documents.write_document(named, str(tmp_path / "m.json"), "short")).read()) == {"a": {"short": "a", "x": 1.5}, "b": {"short": "b", "x": None}}
    many = spark.range(5000).select("id", F.lit("a\n\"ü").alias("s")).repartition(7, "id").orderBy(F.desc("id"))
    assert json.loads(open(documents.write_document(many, str(tmp_path / "m.json"))).read()) == [{"id": k, "s": 'a\n"ü'} for k in reversed(range(5000))]
    assert json.loads(open(documents.write_document(many.limit(0), str(tmp_path / "m.json"))).read()) == [] and json.loads(open(documents.write_document(many.limit(0), str(tmp_path / "m.json"), "id")).read()) == {}
    gaps = spark.createDataFrame([("a", None, None), ("b", None, "e")], "clip string, cut double, error string")
    assert json.loads(open(documents.write_document(gaps, str(tmp_path / "m.json"), optional=("error",))).read()) == [{"clip": "a", "cut": None}, {"clip": "b", "cut": None, "error": "e"}]
    assert not [f for f in tmp_path.iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]
    for name in ("b.mp4", "a.mp4", "c.txt"):
        (tmp_path / name).write_text("x")
    assert [r.name for r in documents.list_files(spark, str(tmp_path)).collect()] == ["a.mp4", "b.mp4"]
    clips = documents.list_files(spark, str(tmp_path)).withColumnRenamed("name", "clip")
    assert [r.clip for r in documents.only(clips, ["b.mp4", "z"]).collect()] == ["b.mp4"] and [r.clip for r in documents.only(clips, limit=1).collect()] == ["a.mp4"]


def test_models_get_batches_and_keep_errors(spark):
    from cutlab.sources import adapters

    def apply(model, batch):
        if (batch["clip"] == "bad").any():
            raise RuntimeError("no frames")
        return batch[["clip"]].assign(n=len(batch) * model)

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "clip string").coalesce(1)
    got = sorted((r.clip, r.n, r.error) for r in adapters.with_model(df, lambda: 10, apply, "n int").collect())
    assert got == [("a", 10, None), ("bad", None, "RuntimeError: no frames"), ("c", 10, None)]
    assert [r[0] for r in spark.createDataFrame([("3.5\n",), ("N/A",), (None,)], "s string").select(adapters.probed_duration(F.col("s"))).collect()] == [3.5, 0.0, 0.0]


def test_stream_of_clips(spark, tmp_path):
    from cutlab.operators import decode
    from cutlab.streaming import segment_stream

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 0.1, 0.0)], "clip string, i int, t double, sim double").write.parquet(src)
    q = segment_stream(spark, src, "clip string, i int, t double, sim double", lambda b: decode.viterbi_states(b), out, str(tmp_path / "ckpt"))
    q.awaitTermination(60)
    assert spark.read.parquet(out).count() == 2
