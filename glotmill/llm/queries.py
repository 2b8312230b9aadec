"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotmill.llm import langid, linededup, mixing, mpeg, packing, sharding, simhash, sketches, toxicity, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    return url_filters.filter_urls(_table(spark, sf_dir, "pages"), url_filters.rule_table(spark, url_filters.RULES))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    got = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as MPEG audio and read back."""
    return mpeg.read_media(mpeg.store_texts(_table(spark, sf_dir, "documents"))).drop("seek")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append all documents as eight arrivals, compact, and read all rows back by the last manifest.

    doc_id, n_bytes and md5 of the text, and the shard's number (by its digest) and rows.
    """
    docs = _table(spark, sf_dir, "documents")
    store = sharding.shard(docs)
    if store is None:
        return docs.select("doc_id", F.lit(0).alias("n_bytes"), F.md5("text").alias("text_md5"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("shard_rows"))
    number = F.row_number().over(sharding.Window.orderBy("rows", "digest", "shard"))
    shards = store.live().select(F.col("shard").alias("_shard"), number.alias("shard"), F.col("rows").alias("shard_rows"))
    return store.rows().join(shards, "_shard").select("doc_id", F.octet_length("text").alias("n_bytes"), F.md5("text").alias("text_md5"), "shard", "shard_rows")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and toxic of every document."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_kept and the md5 of the text that is left of every document."""
    got = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_kept", F.md5("text").alias("kept_md5"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and its likeness to its edited text and to the next document."""
    return sketches.compare_with_edits(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids packed into sequences of at most 2048; one row for each piece."""
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mixing.mix_sizes(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_simhash, op3_language_id, op4_mpeg_media, op5_sharding, op6_toxicity, op7_line_dedup,
        op8_document_fingerprints, op9_packing, op10_mixing, pipeline,
    )
}

ORACLE = {
    "op1_url_filters": r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
urls AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
  FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)
""",
    "op7_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
occ AS (
  SELECT doc_id, i AS no, list_filter(regexp_split_to_array(lines[i], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM d, unnest(generate_series(1, len(lines))) AS t(i)),
worded AS (SELECT doc_id, no, w, array_to_string(w, ' ') AS line FROM occ WHERE len(w) > 0),
firsts AS (SELECT line, any_value(w) AS w, min((doc_id::HUGEINT) * 10000000000 + no) AS place FROM worded GROUP BY line),
variants AS (
  SELECT line, place, 's' || len(w) || ' ' || i || ' ' || array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS key, 0 AS role
  FROM firsts, unnest(generate_series(1, len(w))) AS t(i) WHERE len(w) >= 5
  UNION SELECT line, place, 'd' || array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' '), 1
  FROM firsts, unnest(generate_series(1, len(w))) AS t(i) WHERE len(w) >= 5
  UNION ALL SELECT line, place, 'd' || line, 0 FROM firsts),
buckets AS (
  SELECT key, min(place) FILTER (WHERE role = 0) AS p0, min(place) FILTER (WHERE role = 1) AS p1, max(role) AS d FROM variants GROUP BY key HAVING count(*) > 1),
near AS (
  SELECT DISTINCT line FROM variants JOIN buckets USING (key)
  WHERE CASE WHEN role = 0 AND d = 1 THEN p1 ELSE p0 END < place),
gone AS (
  SELECT doc_id, no FROM worded JOIN firsts USING (line) LEFT JOIN near ON near.line = worded.line
  WHERE near.line IS NOT NULL OR (doc_id::HUGEINT) * 10000000000 + no > place),
lost AS (SELECT doc_id, list(no) AS nos FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(len(lines), 0)::INTEGER AS n_lines,
       coalesce(len(list_filter(generate_series(1, len(lines)), lambda i: NOT list_contains(coalesce(nos, []), i))), 0)::INTEGER AS n_kept,
       md5(array_to_string(list_transform(list_filter(generate_series(1, len(lines)), lambda i: NOT list_contains(coalesce(nos, []), i)), lambda i: lines[i]), chr(10))) AS kept_md5
FROM d LEFT JOIN lost USING (doc_id)
""",
}
