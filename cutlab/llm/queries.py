"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlab.llm import bpe, cube_mix, ego_join, exact_dedup, langid, line_chunks, merkle, minhash, secret_scan, site_style, token_store, toxicity, yinyang
from cutlab.llm.common import held_out, table

#: The tokenizer of the contracts; a name in the folder of public tokenizers.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.main_text(table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), content=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_ids(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


#: What a leaf of the manifest is the digest of, in this order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(LEAF)
    # Tampering deletes line ends, in half of the documents.
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    claimed = merkle.row_digest(*[tampered if c == "text" else F.col(c) for c in LEAF])
    return merkle.check_proofs(merkle.manifest(docs, LEAF, claimed=claimed))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.digest(*yinyang.vector_codes(table(spark, sf_dir, "embeddings")))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (op1_main_text, op2_bpe, op3_toxicity, op4_near_vectors, op5_token_store, op6_language_id, op7_line_dedup, op8_exact_dedup, op9_mix_sources, op10_near_duplicates, op11_merkle_manifest, op12_vector_codes, op13_secret_scan)
    return {f.__name__: f for f in all_}


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"


def merkle_sql() -> str:
    """Trees, proofs and folds, a level a turn of a recursion. The parity of a CRC32 comes from its bits, lowest first."""
    leaf = lambda text: f"sha256(concat({', '.join(_field(text if c == 'text' else c) for c in LEAF)}))"
    bits = "flatten([[(ord(c) >> b) & 1 for b in range(8)] for c in string_split(CAST(doc_id AS VARCHAR), '')])"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"
    fold = lambda start, key, runs, order: f"""SELECT * FROM {start} UNION ALL
        SELECT f.doc_id, {key}f.source, f.level + 1, f.i // 3, proof || array_to_string([h for h, k in hs if k - 1 <> f.i % 3], ''),
            sha256(array_to_string([CASE WHEN k - 1 = f.i % 3 THEN f.c ELSE h END for h, k in hs], ''))
        FROM {order} f JOIN {runs} r ON r.source IS NOT DISTINCT FROM f.source AND r.level = f.level AND r.p = f.i // 3"""  # noqa: E731
    tree = lambda name, source: f"""{name} AS (SELECT source, 0 AS level, i, h, n FROM {source}
        UNION ALL SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY source, level, i // 3, n),
    {name}_runs AS MATERIALIZED (SELECT source, level, i // 3 AS p, list(h ORDER BY i) AS hs FROM {name} WHERE n > 1 GROUP BY ALL)"""  # noqa: E731
    return f"""WITH RECURSIVE
    docs AS MATERIALIZED (SELECT doc_id, source, {leaf("text")} AS h, {leaf(f"CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS claimed,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
    {tree("tree", "docs")},
    sub AS MATERIALIZED (SELECT source AS own, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
    {tree("over_", "(SELECT 0 AS source, i, h, n FROM sub)")},
    low AS ({fold("(SELECT doc_id, source, 0 AS level, i, '' AS proof, claimed AS c FROM docs)", "", "tree_runs", "low")}),
    mid AS MATERIALIZED (SELECT doc_id, 0 AS source, 0 AS level, sub.i, arg_max(proof, level) AS proof, arg_max(c, level) AS c FROM low JOIN sub ON sub.own IS NOT DISTINCT FROM low.source GROUP BY doc_id, sub.i),
    high AS ({fold("mid", "", "over__runs", "high")}),
    done AS (SELECT doc_id, arg_max(proof, level) AS proof, arg_max(c, level) AS c FROM high GROUP BY doc_id)
    SELECT doc_id, docs.h AS leaf, sub.h AS subroot, root, sha256(proof) AS proof_sha256, c AS folded_root, c = root AS verified
    FROM docs JOIN done USING (doc_id) JOIN sub ON sub.own IS NOT DISTINCT FROM docs.source, (SELECT h AS root FROM over_ WHERE n = 1)"""


def codes_sql(rounds: int = 4) -> str:
    """Lloyd's rounds by full scans; entries as (part, entry, list of components)."""
    nearest = lambda k: f"""a{k} AS MATERIALIZED (SELECT x.vec_id, x.part, x.v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
        SELECT x.vec_id, x.part, x.v, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{k} b USING (part)) x GROUP BY x.vec_id, x.part, x.v)"""  # noqa: E731
    moved = lambda k: f"""m{k} AS (SELECT part, entry, list(CAST(floor(s::DOUBLE / n) AS BIGINT) ORDER BY pos) AS v FROM (
        SELECT part, entry, pos, sum(c) AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS c, unnest(range(len(v))) AS pos FROM a{k}) GROUP BY ALL) GROUP BY part, entry),
    b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""  # noqa: E731
    turns = ",\n".join(f"{nearest(k)},\n{moved(k)}" for k in range(rounds))
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(CAST(c AS DOUBLE) * 1024) AS BIGINT) for c in embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    x AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS v FROM kept, range(4) r(part)),
    b0 AS MATERIALIZED (SELECT part, entry, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < 256),
    {turns},
    {nearest(rounds)},
    codes AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
    labels_ AS (SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label) AS label_error FROM codes JOIN kept USING (vec_id)),
    book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM b{rounds})
    SELECT vec_id, code, error, CAST(label_error AS BIGINT) AS label_error, h AS codebooks_sha256 FROM labels_, book"""


def oracle_sql() -> dict[str, str]:
    """Three operators here have SQL; the others are tested against brute force, round trips or held-out accuracy."""
    return {
        "op11_merkle_manifest": merkle_sql(),
        "op12_vector_codes": codes_sql(),
        "op8_exact_dedup": r"""
            WITH d AS (
                SELECT doc_id, length(coalesce(text, '')) AS size,
                       regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
                FROM documents
            ), r AS (
                SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY size DESC, doc_id) AS keep_id,
                       count(*) OVER (PARTITION BY norm) AS group_size
                FROM d
            )
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
        """,
    }
