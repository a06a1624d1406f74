"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import ann, bpe, collocations, exact_dedup, langid, license_scan, mixing, pii, quality, secret_scan, sharding, simhash, whitening
from sievelight.llm.common import documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(langid.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.learn(docs.filter(~held_out))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign_groups(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir), shingle_words=3, max_bits=2)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(quality.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out)
    out = quality.score(docs, quality.learn(docs, labels))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0, k=5)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(documents(spark, sf_dir)))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(documents(spark, sf_dir)))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(out)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = sharding.shuffle_shards(docs, 24)
    return out.select(
        "doc_id",
        sharding.record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        sharding.shard_of(F.col("doc_id"), 25).alias("grown_shard"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(documents(spark, sf_dir))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict:
    ops = (op1_language_id, op2_exact_dedup, op3_simhash, op4_quality, op5_nearest, op6_secrets, op7_bpe, op8_sharding, op9_pii, op10_mixing, op11_license_scan, op12_collocations, op13_whitening)
    return {f.__name__: f for f in ops}


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""


def _secret_arm(no: int, rule: secret_scan.Rule) -> str:
    """Spans of one rule: places from the pieces between matches and the matches before."""
    p = "'" + rule.pattern.replace("'", "''") + "'"
    start = "list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0)"
    keep = f"WHERE length(regexp_extract(found[k], {p}, 2)) >= 6" if rule.kind == "assign" else ""
    return f"""SELECT doc_id, {no} AS no, '{rule.kind}' AS kind, CAST({start} AS BIGINT) AS a, CAST({start} + length(found[k]) AS BIGINT) AS b FROM (
      SELECT doc_id, pieces, found, unnest(range(1, len(found) + 1)) AS k FROM (
        SELECT doc_id, string_split_regex(text, {p}) AS pieces, regexp_extract_all(text, {p}, 0) AS found FROM documents WHERE regexp_matches(text, {p})) x) y {keep}"""


OP6_SQL = f"""
WITH s AS ({" UNION ALL ".join(_secret_arm(no, r) for no, r in enumerate(secret_scan.RULES))}),
t AS (SELECT doc_id, no, kind, a, concat(kind, ':', CAST(a AS VARCHAR), ':', CAST(b AS VARCHAR)) AS tag FROM s)
SELECT d.doc_id,
       count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(tag, ',' ORDER BY a, no) FILTER (no < 3), '')) AS base_sha256,
       coalesce(string_agg(tag, ',' ORDER BY a, no), '') AS spans
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id
"""


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, d, array_to_string(ws[i:i + d - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) s, (VALUES (1), (2), (3), (4)) v(d) WHERE i + d - 1 <= len(ws) GROUP BY ALL
), c AS (
  SELECT lang, d, phrase, f, string_split(phrase, ' ') AS ws FROM g WHERE d >= 2 AND f >= 30
), held AS (
  SELECT DISTINCT c.lang, c.phrase FROM (
    SELECT lang, f, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, f, d, ws, k, unnest(range(1, d - k + 2)) AS i FROM c, (VALUES (2), (3)) v(k) WHERE k < d) x) o
  JOIN c ON c.lang = o.lang AND c.phrase = o.phrase AND 100 * o.f >= 80 * c.f
), cuts AS (
  SELECT lang, phrase, f, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, d)) AS k FROM c ANTI JOIN held USING (lang, phrase)) x
), scored AS (
  SELECT t.lang, t.phrase, t.f AS a, k, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * t.f // (l.f + r.f) AS BIGINT) AS score
  FROM cuts t JOIN g l ON l.lang = t.lang AND l.phrase = t.first JOIN g r ON r.lang = t.lang AND r.phrase = t.rest
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM best JOIN (SELECT lang, sum(f) AS n FROM g WHERE d = 1 GROUP BY lang) t USING (lang) QUALIFY rank <= 2000
"""


def oracle_sql() -> dict:
    return {"op2_exact_dedup": OP2_SQL, "op6_secrets": OP6_SQL, "op12_collocations": OP12_SQL}
