import random

import pytest

import corpus_pipeline
from cutlab.llm import queries
from cutlab.llm.common import stored


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vowels = {"aa": "aei", "oo": "ouy"}
    rows = []

    def text(lang, n):
        return " ".join("".join(rng.choice("bdgk") + rng.choice(vowels[lang]) for _ in range(3)) for _ in range(n))

    for i in range(300):
        lang = rng.choice(["aa", "oo"])
        rows.append((i, "\n".join(text(lang, 30) for _ in range(4)), lang, f"s{i % 4}", 0))
    clean = set(range(300))
    shared = text("aa", 70)
    rows += [(400 + k, text("aa", 60) + "\n" + shared, "aa", "s0", 0) for k in range(5)]
    rows += [(500 + k, rows[k][1].replace("ba", "be", 1), rows[k][2], "s1", 0) for k in range(10)]
    rows += [(600, None, None, None, None), (601, "", "aa", "s1", 0), (602, "123 456", "oo", "s1", 7), (603, rows[0][1], "aa", "s2", 5)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, rows, clean


def test_stages_one_by_one(spark, folder):
    path, rows, clean = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, path))
        seen[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {name: {r.doc_id for r in out} for name, out in seen.items()}
    assert ids["language"] == {r[0] for r in rows} - {600, 601, 602}
    text = {r.doc_id: r.text for r in seen["lines"]}
    assert clean <= ids["lines"] and all(text[i] == rows[i][1] for i in clean)
    assert 603 not in text  # a copy loses all its lines
    assert sum("\n" in r.text for r in seen["lines"] if 400 <= r.doc_id < 405) == 1
    near = ids["near_duplicates"]
    assert clean - near == set() and len(near) == len(seen["near_duplicates"])
    copies = {}
    for r in seen["mix"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= near and max(copies.values()) <= 3
    assert sorted(r.doc_id for r in seen["tokens"]) == sorted(r.doc_id for r in seen["mix"])
    assert len(corpus_pipeline.run(spark, path).collect()) == len(seen["tokens"])


def test_every_operator_is_registered():
    names = queries.queries()
    assert [next(n for n in names if n.startswith(f"op{k}_")) for k in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)


def test_mix_stage_takes_repeated_ids_apart(spark, folder):
    docs = spark.createDataFrame([(1, "a b c", "aa", "s", 5), (1, "d e f", "aa", "s", 5), (1, "d e f", "aa", None, 5), (2, "g h", "aa", "t", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mix(spark, docs, folder[0]).collect()
    assert all(sum(o == r for o in out) <= 3 for r in docs.collect()) and {o for o in out} <= set(docs.collect())


def test_lines_stage_drops_a_copy_of_short_lines(spark, folder):
    """No line of the copy has over 50 words, its four together have."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").filter("doc_id in (0, 1, 603)")
    assert {r.doc_id for r in corpus_pipeline.lines(spark, docs, folder[0]).collect()} == {0, 1}


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder[0])
        assert out.count() == 0 and (name == "tokens" or out.columns == corpus_pipeline.COLUMNS)


def test_stages_on_nulls_and_repeats(spark, folder):
    rows = [(None, None, None, None, None), (None, "some words of the text", None, None, None), (1, None, None, None, None), (1, "", "x", "s", 0), (2, "some words of the text", "x", "s", 1), (2, "some words of the text", "x", "s", 1), (3, " \n ", "x", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {name: sorted(stage(spark, docs, folder[0]).collect(), key=repr) for name, stage in corpus_pipeline.STAGES}
    assert {r.text for r in got["language"]} <= {"some words of the text"}
    assert [tuple(r) for r in got["lines"]] == sorted(rows, key=repr)
    assert {tuple(r) for r in got["near_duplicates"]} >= {rows[0], rows[2], rows[3], rows[6]} and sum(r.text == rows[1][1] for r in got["near_duplicates"]) >= 1
    assert {r.text for r in got["mix"]} == {rows[1][1]}
    assert len(got["tokens"]) == len(rows)
