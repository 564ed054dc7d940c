"""The second stage against a plain restatement, clip by clip."""

import random
import statistics

import pytest
from cutlab.operators import identity, relabel
from cutlab.sources import documents

FIRST = "clip string, i int, start double, end double, start_frame int, end_frame int"


def seen(clip, t):
    frame = min(int(t * clip["fps"]), clip["total"] - 1)
    return max(0.0, clip["scores"].get(frame, 0.0))


def centres(a, b, n):
    return [a + (b - a) * (k + 0.5) / n for k in range(n)]


def cut_point(flags):
    gains = [sum(flags[:i]) + flags[i:].count(False) for i in range(len(flags) + 1)]
    return gains.index(max(gains))


def gradual(clip):
    length = clip["total"] / clip["fps"] if clip["fps"] else 0
    at = centres(0, length, max(2, int(length * 4)))
    flags = [seen(clip, t) >= 0.35 for t in at]
    i, lead = cut_point(flags), max(2, len(at) // 5)
    good = sum(flags[:lead]) >= 0.7 * lead and 0 < i < len(at)
    return round(at[i], 3) if good and at[-1] - at[i] >= 1 and flags[i:].count(False) / len(flags[i:]) >= 0.8 else None


def inside(clip, a, b):
    at = centres(a, b, max(3, int((b - a) * 6)))
    sims = [seen(clip, t) for t in at]
    flags = [s >= 0.45 for s in sims]
    i, lead = cut_point(flags), max(2, len(at) // 5)
    good = sum(sims[:lead]) / lead >= 0.55 and 0 < i < len(at)
    return round(at[i], 3) if good and flags[i:].count(False) / len(flags[i:]) >= 0.6 and statistics.median(sims[i:]) < 0.35 else None


def one_detection(clip, shots):
    sims = [statistics.median(seen(clip, t) for t in centres(a, b, 3)) for a, b in shots]
    i, n = cut_point([s >= 0.35 for s in sims]), len(shots)
    at = None
    if (n == 1 or i == 0) and max(sims) < 0.15:
        method = "all_meme_no_creator"
    elif n == 1 or i == n:
        method = "single_shot_creator" if n == 1 else "all_creator_no_transition"
    else:
        at, method = max(i, 1), "creator_to_meme" if i else "creator_to_meme_prior"
    cut = None if at is None else shots[at][0]
    if at is None and (t := gradual(clip)) is not None:
        cut, method = t, "creator_to_meme_soft"
    elif at is not None and shots[at - 1][1] - shots[at - 1][0] > 0.8:
        t = inside(clip, *shots[at - 1])
        if t is not None and cut - 2.5 <= t < cut - 0.4:
            cut, method = t, "creator_to_meme_softcut"
    return cut, method, sims


def restated(clip):
    shots = clip["first"]
    cut, method, sims = one_detection(clip, shots)
    if cut is None and len(shots) == 1 and len(clip["second"]) > 1:
        shots = clip["second"]
        cut, method, sims = one_detection(clip, shots)
    people = [s >= 0.35 for s in sims]
    if method == "creator_to_meme_prior":
        people = [a < cut - 1e-6 for a, _ in shots]
    elif method in ("single_shot_creator", "all_creator_no_transition"):
        people = [True] * len(shots)
    return (None if cut is None else round(cut, 3)), method, [(*s, round(sim, 3), "person" if p else "meme") for s, sim, p in zip(shots, sims, people)]


def shots_of(rng, length, n):
    marks = sorted(round(rng.uniform(0.1, length - 0.1), 3) for _ in range(n - 1))
    return list(zip([0.0, *marks], [*marks, length]))


@pytest.fixture(scope="module")
def clips():
    rng = random.Random(17)
    out = {}
    for k in range(150):
        fps, total = rng.choice((10.0, 7.5)), rng.choice((30, 60, 90))
        length, kind = total / fps, k % 6
        level = [rng.choice((0.05, 0.3, 0.4, 0.6)) if kind == 0 else 0.6 if kind in (1, 3) else 0.05 if kind == 2 else 0.7 * (f < total * rng.choice((0.4, 0.5))) for f in range(total)]
        scores = {f: round(min(1.0, v + rng.random() * 0.09), 3) for f, v in enumerate(level) if rng.random() < 0.95}
        first = shots_of(rng, length, rng.choice((1, 1, 2, 4)) if kind != 3 else 1)
        out[f"c{k}"] = {"fps": fps, "total": total, "scores": scores, "first": first, "second": shots_of(rng, length, rng.choice((1, 3)))}
    even = {f: 0.9 for f in range(60)}
    # Several shots in the second detection, but no cut: all of its results count.
    out["several, no cut"] = {"fps": 10.0, "total": 60, "scores": even, "first": [(0.0, 6.0)], "second": [(0.0, 2.0), (2.0, 6.0)]}
    # The second detection's first shot holds a gradual change; faces in the second one keep the whole clip from being cut at it.
    fading = {f: 0.9 if f < 30 else 0.6 if 47 <= f < 59 else 0.1 for f in range(80)}
    out["soft cut in the second detection"] = {"fps": 10.0, "total": 80, "scores": fading, "first": [(0.0, 8.0)], "second": [(0.0, 4.0), (4.0, 8.0)]}
    out["no frames"] = {"fps": 0.0, "total": 0, "scores": {}, "first": [(0.0, 1.0)], "second": [(0.0, 1.0)]}
    return out


def tables(spark, clips):
    rows = lambda which: [(c, i, a, b, i, i + 1) for c, x in clips.items() for i, (a, b) in enumerate(x[which])]
    return (
        spark.createDataFrame(rows("first"), FIRST), spark.createDataFrame([(c, x["fps"], x["total"]) for c, x in clips.items()], "clip string, fps double, total int"),
        spark.createDataFrame([(c, f, s) for c, x in clips.items() for f, s in x["scores"].items()], "clip string, idx int, sim double"), spark.createDataFrame(rows("second"), FIRST),
    )


def test_relabel_equals_the_restatement(spark, clips):
    first, info, scores, second = tables(spark, clips)
    asked = []

    def detect(left):
        asked.extend(r.clip for r in left.collect())
        return second.join(left, "clip", "left_semi")

    shots, decided = relabel.relabel(first, info, scores, detect)
    got = {r.clip: (r.cut, r.method, []) for r in decided.collect()}
    for r in sorted(shots.collect(), key=lambda r: r.i):
        got[r.clip][2].append((r.start, r.end, round(r.sim, 3), r.label))
    want = {c: restated(x) for c, x in clips.items()}
    assert got == want
    assert want["several, no cut"][:2] == (None, "all_creator_no_transition") and len(want["several, no cut"][2]) == 2
    assert want["soft cut in the second detection"][1] == "creator_to_meme_softcut"
    assert {m for _, m, _ in want.values()} >= {"creator_to_meme", "creator_to_meme_soft", "creator_to_meme_softcut", "creator_to_meme_prior", "all_meme_no_creator", "single_shot_creator", "all_creator_no_transition"}
    # The second detection runs for single shots without a cut alone.
    assert set(asked) == {c for c, x in clips.items() if len(x["first"]) == 1 and one_detection(x, x["first"])[0] is None} and len(asked) < len(clips)


def test_switches(spark, clips):
    first, info, scores, second = tables(spark, clips)
    off = relabel.Options(soft=False, second=False)
    got = {r.clip: (r.cut, r.method) for r in relabel.relabel(first, info, scores, second, off)[1].collect()}
    assert not {m for _, m in got.values()} & {"creator_to_meme_soft", "creator_to_meme_softcut"} and got["several, no cut"] == (None, "single_shot_creator")


def test_documents_keep_what_could_not_be_labelled(spark, clips):
    first, info, scores, second = tables(spark, {"a.mp4": clips["several, no cut"], "gone.mp4": clips["c0"]})
    shots, decided = relabel.relabel(first, info, scores, second)
    old = [{"clip": c, "transition_sec": 1.5, "method": "old", "shots": s, "error": e} for c, s, e in (("a.mp4", [{"start_sec": 0.0, "end_sec": 6.0}], None), ("gone.mp4", [{"start_sec": 0.0}], None), ("bad.mp4", None, "no frames"), ("empty.mp4", [], None))]
    records = spark.createDataFrame(old, documents.TRANSITIONS)
    files = spark.createDataFrame([("a.mp4",), ("bad.mp4",), ("empty.mp4",)], "clip string")
    got = {r.clip: r for r in relabel.documents(records, files, shots, decided).collect()}
    assert set(got) == {x["clip"] for x in old} and {c for c, r in got.items() if r.face_error} == {"gone.mp4", "bad.mp4", "empty.mp4"}
    assert got["gone.mp4"].method == "old" and got["gone.mp4"].transition_sec == 1.5 and got["bad.mp4"].error == "no frames"
    a = got["a.mp4"]
    assert (a.transition_sec, a.method, a.num_shots) == (None, "all_creator_no_transition", 2)
    assert [(s.start_sec, s.end_sec, s.start_frame, s.end_frame, s.face_sim, s.label) for s in a.shots] == [(0.0, 2.0, 0, 1, 0.9, "person"), (2.0, 6.0, 1, 2, 0.9, "person")]


def test_enrol_takes_the_largest_face_of_one_frame(spark):
    turn = lambda x, y: [float(x), float(y), 0.0]
    rows = [(f"c{k}", 10, 0, [0.0, 0.0, 2.0, 2.0], turn(0, 1)) for k in range(6)] + [(f"c{k}", 10, 1, [0.0, 0.0, 3.0, 3.0], turn(1, 0.1 * k)) for k in range(6)]
    rows += [("c0", 11, 0, [0.0, 0.0, 9.0, 9.0], turn(0, -1)), ("short", 4, 0, [0.0, 0.0, 1.0, 1.0], turn(1, 0)), ("c9", 10, 0, [0.0, 0.0, 5.0, 5.0], turn(-1, 0)), ("tie", 10, 1, [0.0, 0.0, 1.0, 1.0], turn(0, -1)), ("tie", 10, 0, [0.0, 0.0, 1.0, 1.0], turn(1, 0))]
    faces = spark.createDataFrame(rows, "clip string, idx int, face_no int, bbox array<double>, embedding array<double>")
    info = spark.createDataFrame([(c, 10.0, 5 if c == "short" else 40) for c in {r[0] for r in rows}] + [("none", 10.0, 40)], "clip string, fps double, total int")
    (one,) = identity.enrol(faces, info).collect()
    assert (one.n, one.n_inliers) == (9, 8)  # all openings but that of c9 look alike
    unit = [[v / (x * x + y * y) ** 0.5 for v in (x, y)] for x, y in [(1, 0.1 * k) for k in range(6)] + [(1, 0), (1, 0)]]
    mean = [statistics.mean(c) for c in zip(*unit)]
    size = sum(c * c for c in mean) ** 0.5
    assert one.centroid == pytest.approx([c / size for c in mean] + [0.0])
    sims = {(r.clip, r.idx): r.sim for r in identity.frame_scores(faces, spark.createDataFrame([one])).collect()}
    assert sims["c9", 10] == 0.0 and sims["c0", 10] == pytest.approx(one.centroid[0])
    assert identity.enrol(faces.limit(0), info).count() == 0
