"""The operators of this subpackage applied to their whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import (
    curriculum, decision_list, hard_negatives, induced_sort, lattice, page_slots, passages,
    secret_tests, simhash, spaced_seeds, spectra, substring_windows, template,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_suffix_array_dedup", """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS w
      FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 199)) AS i FROM b)),
r AS (SELECT doc_id, i FROM s SEMI JOIN (SELECT w FROM s GROUP BY w HAVING count(*) > 1) USING (w)),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM r),
n AS (SELECT doc_id, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END)
      OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS z FROM n GROUP BY doc_id, run),
k AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM u),
p AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last,
      string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS parts
      FROM k JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(parts, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN p USING (doc_id)
""")
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return induced_sort.remove_repeated_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


@query("op4_substring_dedup", f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM s SEMI JOIN (SELECT k FROM s GROUP BY k HAVING count(*) > 1) USING (k)),
x AS (SELECT DISTINCT doc_id, i + unnest(range(35)) AS i FROM r),
t AS (SELECT d.doc_id, u.i, w[u.i] AS word, x.i IS NULL AS stays
      FROM d, unnest(range(1, len(w) + 1)) AS u(i) LEFT JOIN x ON x.doc_id = d.doc_id AND x.i = u.i),
g AS (SELECT doc_id, count(*) FILTER (WHERE NOT stays) AS n_removed,
      string_agg(word, ' ' ORDER BY i) FILTER (WHERE stays) AS kept FROM t GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
""")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_windows.remove_repeated_windows(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _sql_compared(column: str) -> str:
    plain = f"regexp_replace(lower(coalesce({column}, '')), " \
            r"'[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g')"
    return rf"regexp_extract_all({plain}, '[^\x20\x09-\x0D]+')"


@query("op6_benchmark_decontamination", f"""
WITH d AS (SELECT doc_id, {_sql_compared('text')} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_sql_compared('text')} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
bw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS q FROM b),
shifts AS (SELECT doc_id, item_id, n, dw.i - bw.q AS shift, count(*) AS equal
           FROM dw JOIN bw USING (word) GROUP BY ALL
           HAVING count(*) >= least(12, n) OR 10 * count(*) >= 8 * n),
along AS (SELECT doc_id, item_id, n, shift, equal, q,
            CASE WHEN b.w[q + 1] = d.w[q + shift + 1] THEN 1 ELSE -2 END AS gain
          FROM shifts JOIN d USING (doc_id) JOIN b USING (item_id), unnest(range(len(b.w))) AS u(q)
          WHERE q + shift BETWEEN 0 AND len(d.w) - 1),
sums AS (SELECT *, sum(gain) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q) AS total FROM along),
runs AS (SELECT doc_id, item_id, n, equal, total - least(0, coalesce(min(total) OVER (
           PARTITION BY doc_id, item_id, shift ORDER BY q
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS score, shift FROM sums),
best AS (SELECT doc_id, item_id, n, shift, equal, max(score) AS score FROM runs GROUP BY ALL)
SELECT doc_id, item_id, max(score)::BIGINT AS score FROM best
WHERE score >= least(12, n) OR 10 * equal >= 8 * n GROUP BY doc_id, item_id
""")
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_curriculum_mixing", f"""
WITH d AS (SELECT doc_id, source, len({SQL_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind, [3, 1, 2][kind + 1] AS weight
      FROM d GROUP BY source),
levels AS (SELECT 2 * source_size / weight AS level FROM s UNION SELECT 0),
filled AS (SELECT level, (SELECT sum(least(2 * source_size, weight * level)) FROM s) AS total,
             (SELECT sum(weight) FROM s WHERE 2 * source_size / weight > level) AS open_weight
           FROM levels),
chosen AS (SELECT level + ((SELECT sum(size) * 1.5 FROM d) - total) / open_weight AS level FROM filled
           WHERE total <= (SELECT sum(size) * 1.5 FROM d) AND open_weight > 0
           ORDER BY filled.level DESC LIMIT 1),
t AS (SELECT source, source_size, kind,
        least(2.0 * source_size, weight * (SELECT level FROM chosen))::DOUBLE AS target FROM s),
o AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source
        ORDER BY md5(doc_id::VARCHAR), doc_id) - size AS start FROM d),
j AS (SELECT doc_id, size, source_size, target, kind, start + source_size * copy AS begin, copy,
        greatest(0, least(size, floor(target) - start - source_size * copy)) AS words
      FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) c(copy)),
u AS (SELECT *, begin::DOUBLE / floor(target) AS share FROM j WHERE words > 0),
p AS (SELECT doc_id, copy, CASE WHEN share = 0 THEN 0 WHEN kind = 0 THEN share
        WHEN kind = 1 THEN (sqrt(0.04::DOUBLE + 3.2::DOUBLE * share) - 0.2::DOUBLE) / 1.6::DOUBLE
        ELSE (1.8::DOUBLE - sqrt(3.24::DOUBLE - 3.2::DOUBLE * share)) / 1.6::DOUBLE END AS position
      FROM u),
k AS (SELECT *, row_number() OVER (ORDER BY position, doc_id, copy) AS rank FROM p),
f AS (SELECT doc_id, count(*) AS n_uses, min(position) AS position, min(rank) AS rank
      FROM k GROUP BY doc_id)
SELECT doc_id, size, source_size, round(target, 4) AS target, sum(words)::BIGINT AS taken,
  coalesce(any_value(n_uses), 0)::BIGINT AS n_uses, round(any_value(f.position), 6) AS first_position,
  coalesce(any_value(f.rank), 0) AS first_rank
FROM j LEFT JOIN f USING (doc_id) GROUP BY doc_id, size, source_size, target
""")
def op7_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", "source", curriculum.document_sizes(docs, "text").alias("size"))
    return curriculum.place(sizes).select(
        "doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", "n_uses",
        F.round("first_position", 6).alias("first_position"),
        F.coalesce("first_rank", F.lit(0)).alias("first_rank"))


@query("op1_secret_scans")
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_tests.find_secrets(table(spark, sf_dir, "documents"))


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

#: A conversation made of control strings alone.
CONTROL = "<|im_end|><|im_start|>assistant ok"


@query("op10_chat_formatting")
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(
        [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], real.schema)
    return template.format_digests(real.unionByName(added))


@query("op5_attention_quality")
def op5_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_lattice_scoring")
def op8_lattice_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(table(spark, sf_dir, "documents"))


@query("op11_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_html_extraction", r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(
    regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(p|h1)>', chr(1), 'g'),
    '<[^>]*>', ' ', 'g'), '&amp;?', '&', 'g') AS t FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(
    string_split(replace(t, '&quot;', '"'), chr(1)),
    lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM a)
SELECT page_id, url, coalesce(array_to_string(parts, chr(10)), '') AS text,
  len(coalesce(array_to_string(parts, chr(10)), '')) AS n_chars FROM b
""")
def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_slots.extract(table(spark, sf_dir, "pages"))
