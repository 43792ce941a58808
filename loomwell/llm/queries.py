"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm import bpe, byte_bpe, decontaminate, html_text, importance, katz, langid, ngram_join, quality, shard, spelling, topk, toxicity


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"), percent=80)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(_read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_read(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), vocabulary())


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_read(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(_read(spark, sf_dir, "documents"), shards=16)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), percent=80)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), buckets=10_000, longest=1, min_words=20, percent=10, seed=2024)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_read(spark, sf_dir, "documents"), min_length=7, min_count=2, factor=10, every=31)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_documents(_read(spark, sf_dir, "documents"), byte_ranks(), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_topk_search, op2_ngram_jaccard, op3_lm_scoring, op4_quality, op5_language_id, op6_bpe, op7_html_extraction, op8_sharding,
        op9_toxicity, op10_decontamination, op11_importance_resampling, op12_spelling_variants, op13_byte_bpe, pipeline,
    )
    return {f.__name__: f for f in own}


#: What is exact and has no model is plain SQL. DuckDB's list functions spell out the contracts; it has no crc32, so that is
#: folded over the bytes, each followed by eight shifts (-1).
OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


_CRC = """
xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(0, octet_length(encode(WORD))), lambda i:
  [CAST('0x' || substr(hex(encode(WORD)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))
"""


def _crc(word: str) -> str:
    return _CRC.replace("WORD", word)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
), b AS (
  SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), words AS (
  SELECT word, {_crc("word")} % 10000 AS bucket FROM (SELECT word FROM w UNION SELECT word FROM b)
), s AS (
  SELECT bucket, count(*) AS s FROM w JOIN words USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM b JOIN words USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(
    CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM w) + 10000 AS DOUBLE)
    / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM b) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)
), d AS (
  SELECT doc_id, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM w JOIN words USING (word) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM documents LEFT JOIN d USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, rank
FROM scored LEFT JOIN (SELECT * FROM ranked WHERE rank <= (SELECT count(*) // 10 FROM ranked)) USING (doc_id)
"""

OP12_SQL = rf"""
WITH RECURSIVE run AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT *, {_crc("(doc_id || ':' || run)")} AS h FROM run
), vocab AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), place AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab
), wild AS (
  SELECT word, n, i, word[1 : i - 1] AS prefix, word[i + 1 :] AS suffix FROM place
), shorter AS (
  SELECT DISTINCT word, prefix || suffix AS other FROM wild
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM wild a JOIN wild b USING (i, prefix, suffix) WHERE a.word <> b.word
  UNION ALL
  SELECT s.word, s.other, v.n FROM shorter s JOIN vocab v ON v.word = s.other
  UNION ALL
  SELECT s.other, s.word, w.n FROM shorter s JOIN vocab v ON v.word = s.other JOIN vocab w ON w.word = s.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most, arg_max(other, (other_n, -rn)) AS other
  FROM (SELECT *, row_number() OVER (ORDER BY encode(other)) AS rn FROM near) GROUP BY word
), formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN other END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n
  FROM vocab LEFT JOIN best USING (word)
), chain AS (
  SELECT word, form AS last, 1 AS steps FROM formed WHERE form IS NOT NULL
  UNION ALL
  SELECT c.word, f.form, c.steps + 1 FROM chain c JOIN formed f ON f.word = c.last WHERE f.form IS NOT NULL
), root AS (
  SELECT word, arg_max(last, steps) AS root FROM chain GROUP BY word
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN root USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1_SQL, "op11_importance_resampling": OP11_SQL, "op12_spelling_variants": OP12_SQL}
