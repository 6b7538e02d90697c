"""The registered queries of this subpackage and their DuckDB SQL.

Each query reads its whole table, applies one operator with production
parameters and derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import digests, encode_decode
from .decontaminate import find_passages
from .html_extract import extract_text
from .langid import identify, train as train_languages
from .licenses import scan
from .line_dedup import dedup_lines
from .merkle import fold, manifest, siblings
from .near_dup import near_duplicates
from .pii import digests as span_digests, find_spans
from .quality import judge
from .token_counts import count_tokens
from .toxicity import score_toxicity, train
from .whitening import whiten

# joins keep all their keys, so that hot keys can be split at run time
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    "spark.sql.session.timeZone": "UTC",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


TOXIC = 0.7


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, _table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"),
                         F.col("evidence.doc_id").alias("evidence"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    ids = F.array_sort(F.array_distinct(F.filter(F.col("found.item_id"), lambda x: x.isNotNull())))
    return found.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def tokenizer_file(name: str) -> str:
    """Where an installed vocabulary file of a public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(find_spans(_table(spark, sf_dir, "documents")))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.col("notices.family")))
    return found.select("doc_id", "n_paragraphs", F.size("notices").cast("long").alias("n_notices"),
                        F.array_join(names, ",").alias("families"), F.col("notices.paragraph").alias("paragraphs"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return dedup_lines(docs.withColumn("n_lines", lines)).select("doc_id", "n_lines", "n_dropped", "text")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    one_more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    proved = manifest(_table(spark, sf_dir, "documents"), changed={"n_chars": one_more})
    return (proved.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
                          fold(F.col("changed"), F.col("proof")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    model = train_languages(docs.filter(rest != 2))
    return identify(docs, model, columns=["doc_id"]).select(
        "doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
      THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * i >= 85 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (
  SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id,
       coalesce(m.c, d.doc_id) IS NOT DISTINCT FROM d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m,
         unnest([array_to_string(w[k:k + least(len(w), 10) - 1], ' ') FOR k IN range(1, greatest(len(w) - 8, 2))]) AS g
  FROM i WHERE len(w) > 0),
t AS (
  SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS k,
         unnest([array_to_string(w[k:k + m - 1], ' ') FOR k IN range(1, len(w) - m + 2)]) AS g
  FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m),
o AS (SELECT t.doc_id, p.item_id, t.k, t.m FROM t JOIN p ON t.g = p.g AND t.m = p.m),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS x FROM o) GROUP BY doc_id),
s AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS t FROM documents),
l AS (
  SELECT doc_id, i, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(range(0, len(t))) AS i, unnest(t) AS text FROM d WHERE doc_id IS NOT NULL)),
u AS (
  SELECT w, len(w) AS n, min((doc_id, i)) AS pos FROM l WHERE len(w) >= 5 GROUP BY w),
v AS (
  SELECT w, n, pos, unnest(range(1, n + 1)) AS k, unnest([array_to_string(w[1:k - 1] || w[k + 1:], ' ') FOR k IN range(1, n + 1)]) AS g
  FROM u WHERE n >= 8),
p AS (
  SELECT a.w, b.pos FROM v a JOIN v b ON a.g = b.g AND a.n = b.n AND a.k = b.k AND a.w <> b.w
  UNION ALL
  SELECT v.w, u.pos FROM v JOIN u ON v.g = array_to_string(u.w, ' ') AND u.n = v.n - 1 AND u.n >= 8
  UNION ALL
  SELECT u.w, v.pos FROM v JOIN u ON v.g = array_to_string(u.w, ' ') AND u.n = v.n - 1 AND u.n >= 8
  UNION ALL
  SELECT w, pos FROM u),
o AS (SELECT w, min(pos) AS pos FROM p GROUP BY w),
x AS (SELECT doc_id, list(i) AS gone FROM l JOIN o ON l.w = o.w WHERE o.pos < (l.doc_id, l.i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(t), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
       CASE WHEN gone IS NULL THEN text
            ELSE coalesce(array_to_string([t[k + 1] FOR k IN range(0, len(t)) IF NOT list_contains(gone, k)], chr(10)), '') END AS text
FROM d LEFT JOIN x ON x.doc_id = d.doc_id
"""


OP12_SQL = r"""
WITH RECURSIVE f(s) AS (SELECT NULL),
d AS (
  SELECT doc_id, lang, n_chars AS c, row_number() OVER () AS r,
    CASE WHEN list_reduce(list_concat([4294967295::UBIGINT], [ascii(x)::UBIGINT FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384::UBIGINT * (c & 1)))) IS NULL
      THEN false ELSE
      xor(list_reduce(list_concat([4294967295::UBIGINT], [ascii(x)::UBIGINT FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384::UBIGINT * (c & 1)))), 4294967295::UBIGINT) % 7 = 0
    END AS t,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS p,
    coalesce(strlen(text) || ':' || text, '-') AS q
  FROM documents),
e AS (
  SELECT doc_id, lang, r, sha256(p || coalesce(strlen(CAST(c AS VARCHAR)) || ':' || CAST(c AS VARCHAR), '-') || q) AS leaf,
    CASE WHEN t AND c IS NOT NULL THEN sha256(p || strlen(CAST(c + 1 AS VARCHAR)) || ':' || CAST(c + 1 AS VARCHAR) || q) END AS bad
  FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM e),
t(lang, level, idx, digest, n) AS (
  SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), count(*) OVER (PARTITION BY lang)
  FROM t WHERE n > 1 GROUP BY lang, level, idx // 2),
s AS (
  SELECT lang, digest AS subroot, level AS high, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM t WHERE n = 1),
u(level, idx, digest, n) AS (
  SELECT 0, pos, subroot, count(*) OVER () FROM s
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), count(*) OVER () FROM u WHERE n > 1 GROUP BY level, idx // 2),
-- every leaf climbs: its own digest with or without the change, and the siblings met so far
c(doc_id, lang, r, leaf, level, idx, digest, proof, part) AS (
  SELECT doc_id, lang, r, leaf, 0, pos, coalesce(bad, leaf), '', 0 FROM leaves
  UNION ALL
  SELECT c.doc_id, c.lang, c.r, c.leaf,
    CASE WHEN c.part = 0 AND c.level = s.high THEN 0 ELSE c.level + 1 END,
    CASE WHEN c.part = 0 AND c.level = s.high THEN s.pos ELSE c.idx // 2 END,
    CASE WHEN c.part = 0 AND c.level = s.high THEN c.digest
         WHEN c.idx % 2 = 1 THEN sha256(coalesce(a.digest, b.digest) || c.digest)
         ELSE sha256(c.digest || coalesce(a.digest, b.digest, '')) END,
    c.proof || coalesce(a.digest, b.digest, ''),
    CASE WHEN c.part = 0 AND c.level = s.high THEN 1 ELSE c.part END
  FROM c JOIN s ON s.lang IS NOT DISTINCT FROM c.lang
  LEFT JOIN t a ON c.part = 0 AND a.lang IS NOT DISTINCT FROM c.lang AND a.level = c.level AND a.idx = xor(c.idx, 1)
  LEFT JOIN u b ON c.part = 1 AND b.level = c.level AND b.idx = xor(c.idx, 1)
  WHERE c.part = 0 OR c.level < (SELECT max(level) FROM u))
SELECT c.doc_id, c.leaf, s.subroot, (SELECT digest FROM u WHERE n = 1) AS root, sha256(c.proof) AS proof_sha256,
       c.digest AS folded_root, c.digest = (SELECT digest FROM u WHERE n = 1) AS verified
FROM c JOIN s ON s.lang IS NOT DISTINCT FROM c.lang
WHERE c.part = 1 AND c.level = (SELECT max(level) FROM u)
"""


def queries() -> dict:
    return {
        "op1_html_text": op1_html_text,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_toxicity": op3_toxicity,
        "op4_token_counts": op4_token_counts,
        "op5_decontaminate": op5_decontaminate,
        "op6_bpe": op6_bpe,
        "op7_quality": op7_quality,
        "op8_pii": op8_pii,
        "op9_licences": op9_licences,
        "op10_line_dedup": op10_line_dedup,
        "op11_whitening": op11_whitening,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_language": op13_language,
    }


def oracle_sql() -> dict:
    return {"op2_near_duplicates": OP2_SQL, "op5_decontaminate": OP5_SQL, "op10_line_dedup": OP10_SQL,
            "op12_merkle_manifest": OP12_SQL}
