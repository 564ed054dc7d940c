"""A corpus from raw documents: five stages, each one operator, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes
each result as Parquet in the shared folder and reads it back for the next one,
so that a lost executor costs no more than the stage that runs. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlab.llm import bpe, cube_mix, langid, line_chunks, minhash
from cutlab.llm.common import held_out, stored, table
from cutlab.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is less certain than this are rejected.
LEAST_CERTAIN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or a likely language; ``lang`` becomes the predicted one.

    Null and empty texts have no letter and go; a null lang is predicted like
    any other. Learns from the labelled rows of the raw documents; where there
    are none, no language is known and every document goes. Repeated rows are
    judged each. An empty table stays empty, here and in all stages.
    """
    labelled = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(labelled.filter(~held_out()))
    known = langid.predict(docs.select(COLUMNS), model).filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_CERTAIN))
    return known.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated chunks of lines; documents that lose all their words go.

    A document that loses nothing stays as it is, blank or null text included.
    Of repeats the one with the smallest id keeps its lines, a null id before
    all; rows of the same id and text are one occurrence, and all keep them.
    """
    clean = line_chunks.dedup_lines(docs.select(COLUMNS))
    clean = clean.filter((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n\r\t\x0b\x0c", "     ")) != ""))
    return clean.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest id.

    Null and blank texts are like nothing and stay; so do all rows of the
    smallest id, if rows repeat it. A null id has no place in the order of ids:
    such rows stay.
    """
    gone = minhash.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix says: not at all, or as up to three rows.

    Documents without a word, null texts included, have nothing to take and go.
    A null source is a source, the last one. Rows that repeat an id are taken
    each for themselves.
    """
    copies = cube_mix.mix_sources(docs).filter("copies > 0")
    # Rows that repeat an id are told apart by their source, size and place among equals.
    copies = copies.select("doc_id", F.col("source").alias("of"), F.col("size").alias("words"), "copies")
    numbered = copies.selectExpr("*", "row_number() over (partition by doc_id, of, words order by copies desc) as nth")
    rows = docs.select(COLUMNS).withColumn("words", cube_mix.word_count("text"))
    rows = rows.selectExpr("*", "row_number() over (partition by doc_id, source, words order by xxhash64(text)) as nth")
    same = rows.doc_id.eqNullSafe(numbered.doc_id) & rows.source.eqNullSafe(numbered.of) & (rows.words == numbered.words) & (rows.nth == numbered.nth)
    taken = rows.join(numbered, same).select(*[rows[c] for c in COLUMNS], "copies")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again; a null text counts as empty, and repeated rows are encoded each."""
    return bpe.encode_decode(docs, tokenizer_path(), content=False)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: Language ID and MinHash have no SQL form; tests plant copies, passages and junk in a small corpus and follow them through the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
