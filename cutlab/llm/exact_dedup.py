"""Exact duplicates: grouping by a 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlab.llm.common import SPACES, drop_stored, stored, text_or_empty

#: Rows of a group that share one copy of its first text when bytes are compared.
SALT_ROWS = 512


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.translate(text, SPACES, "")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=content_hash) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space; a null
    text counts as empty. Of equal texts the one with most code points before
    that stays, then the smallest id, null ids last. Rows that repeat an id are
    counted each and all get the group's keep_id; ``kept`` is then true for each
    of them, and never null. An empty table gives no rows; other columns do not
    matter.

    Only a few dozen bytes a document are grouped and joined by hash; texts are
    shuffled by id, and of those only the ones whose hash occurs again go on.
    Each of them is compared with its group's first text, which is copied once
    per SALT_ROWS members, so that a group that holds a third of all rows
    spreads over many tasks. Should texts differ in spite of an equal hash,
    those groups are formed once more by hash and text. ``hashed`` can be
    replaced, to test that.
    """
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("raw")).select(
        "id", F.length("raw").cast("long").alias("size"), normalised(F.col("raw")).alias("text")
    )
    texts = texts.withColumn("hash", hashed(F.col("text")))
    slim = stored(texts.select("id", "size", "hash", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")))
    best = F.max(F.struct(F.col("size"), (-F.col("id")).alias("minus_id"))).alias("best")
    groups = slim.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), best)
    groups = stored(groups)  # so that the join below can split a large group
    rows = stored(slim.join(groups, "hash").select("id", "size", "hash", "sha", "n", "first_id", (-F.col("best.minus_id")).alias("keep_id")))
    drop_stored(slim, groups)

    again = rows.filter("n > 1").select("id", "hash", "n", "first_id").distinct()
    again = again.select(F.col("id").alias("own_id"), F.col("hash").alias("own_hash"), "n", "first_id")
    members = texts.select("id", "hash", "text").join(again, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash"))).drop("own_id", "own_hash")
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    members = stored(members.withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")))
    first = members.filter("id <=> first_id").groupBy("hash", "salts").agg(F.min("text").alias("first_text"))
    first = first.select("hash", "first_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    clashes = stored(members.join(first, ["hash", "salt"]).filter("text <> first_text").select("hash").distinct())

    if not clashes.isEmpty():
        clashed = texts.join(clashes, "hash")
        by_text = clashed.groupBy("hash", "text").agg(F.count("*").alias("n"), best)
        settled = clashed.select("id", "hash", "text").join(by_text, ["hash", "text"])
        settled = settled.select("id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "n", (-F.col("best.minus_id")).alias("keep_id"))
        rows = rows.join(clashes, "hash", "left_anti").select("id", "sha", "n", "keep_id").unionByName(settled)
    return rows.select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
