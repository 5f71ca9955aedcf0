"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import align, ann, bpe, decontaminate, html_extract, jaccard, licences, mixing, quality, spelling, topk, toxicity, warc
from orrery.llm.common import read_table


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(read_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.digests(bpe.decode(bpe.encode(docs, "doc_id", "text"), "doc_id"), "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.flag(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.schedule(read_table(spark, sf_dir, "documents").select("doc_id", "source"))
    return placed.select("doc_id", "source", "mix_block", "mix_phase", "mix_slot", "mix_place")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read_table(spark, sf_dir, "pages"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), ann.every_nth(20), k=20)


def op4_exact_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top(read_table(spark, sf_dir, "embeddings"), ann.every_nth(50), k=5)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages")).drop("intact")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read_table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(read_table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": op1_main_text,
        "op2_nearest": op2_nearest,
        "op3_quality": op3_quality,
        "op4_exact_top": op4_exact_top,
        "op5_licences": op5_licences,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_warc": op7_warc,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_toxicity": op9_toxicity,
        "op10_mixing": op10_mixing,
        "op11_tokenizer_alignment": op11_tokenizer_alignment,
        "op12_decontamination": op12_decontamination,
        "op13_spelling_variants": op13_spelling_variants,
    }


OP2_SQL = """
WITH ok AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP4_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


OP7_SQL = """
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
large AS (
  SELECT digest, max(page_id) AS keeper FROM rows WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1)
SELECT r.page_id, CAST(r.n AS BIGINT) AS payload_bytes, r.digest AS payload_digest,
  CASE WHEN k.keeper IS NOT NULL AND r.page_id IS DISTINCT FROM k.keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.keeper IS NOT NULL AND r.page_id IS DISTINCT FROM k.keeper THEN k.keeper END AS refers_to
FROM rows r LEFT JOIN large k USING (digest)
"""


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s + 1 : s + 10], ' ') AS win FROM starts),
sizes AS (SELECT DISTINCT m FROM wins),
places AS (SELECT r, m, unnest(range(len(w) - m + 1)) AS p, w FROM d, sizes WHERE len(w) >= m),
met AS (SELECT r, p, x.m, item_id FROM (SELECT r, m, p, array_to_string(w[p + 1 : p + m], ' ') AS win FROM places) x JOIN wins USING (m, win)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT r, p, m FROM met)) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""


OP13_SQL = r"""
WITH RECURSIVE table_ AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{6,}')) AS run FROM documents),
kinds AS (SELECT doc_id, run, count(*) AS k FROM found GROUP BY ALL),
coded AS (
  SELECT run, k, list_transform(string_split(concat(CAST(doc_id AS VARCHAR), ':', run), ''), lambda c: ord(c)) AS codes FROM kinds),
bytes AS (
  SELECT run, k, flatten(list_transform(codes, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + c // 64, 128 + c % 64] END)) AS b FROM coded),
hashed AS (
  SELECT run, k, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM bytes, table_),
typed AS (
  SELECT CASE WHEN h % 199 = 0 THEN concat(substring(run, 1, CAST(h % length(run) AS BIGINT)), substring(run, CAST(h % length(run) AS BIGINT) + 2)) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
rests AS (
  SELECT word, i, concat(substring(word, 1, i - 1), substring(word, i + 1)) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM rests a JOIN rests b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word FROM rests a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, a.word FROM rests a JOIN words w ON a.rest = w.word),
ranked AS (
  SELECT p.word, near, w.n AS near_n, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, near) AS place, count(*) OVER (PARTITION BY p.word) AS n_near
  FROM pairs p JOIN words w ON w.word = p.near),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
chain AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f JOIN ends e USING (word)
"""


def oracle_sql() -> dict[str, str]:
    """Only what SQL expresses; the others are tested against brute force."""
    return {"op2_nearest": OP2_SQL, "op4_exact_top": OP4_SQL, "op7_warc": OP7_SQL, "op12_decontamination": OP12_SQL, "op13_spelling_variants": OP13_SQL}
