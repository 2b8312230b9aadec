"""A corpus pipeline of five stages over documents: identify, dedup lines, drop near copies, mix, pack."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotmill.llm import langid, linededup, mixing, packing, resemblance
from glotmill.llm.common import WORD, Scratch, cut, shared_dir, small_batches, take

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the network can't tell (no text, no letters, a score under 0.3)."""
    small_batches(spark)
    return langid.keep_identified(docs, COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that earlier ones repeat, and documents that lose words with all their lines."""
    out = linededup.dedup_lines(docs, columns=COLUMNS)
    return _counted(out.where((F.col("n_kept") == F.col("n_lines")) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def _originals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame | None:
    """(key, _h, text) for those of docs(_h, doc_id, text) that documents has, under the same id, with more lines: the whole text.

    A document's lines must all be there, so that a row that isn't from documents keeps to its own text. Of several rows with
    one id, that is the one with the shortest text that also has the first line with words. None if sf_dir has no documents.
    """
    try:
        whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    scratch, name = Scratch(spark), F.xxhash64(F.col("doc_id").cast("string")).alias("_id")
    whole = take(whole, "doc_id", "text").select(name, F.col("text").alias("_whole"))
    cut_ones = docs.where(F.col("text").rlike(WORD)).select("_h", name, "text")
    repeated = scratch.keep(whole.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select("_id"), "repeated")
    all_there = (F.col("text") != F.col("_whole")) & (F.size(F.array_except(F.split("text", "\n"), F.split("_whole", "\n"))) == 0)

    found = cut_ones.join(whole.join(repeated, "_id", "left_anti"), "_id").where(all_there).select("_h", "_whole")
    line = F.get(F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)), F.lit(0))
    several = cut_ones.join(repeated, "_id", "left_semi").dropDuplicates(["_h"]).withColumn("_line", line)
    lines = whole.join(repeated, "_id", "left_semi").distinct().withColumn("_line", F.explode(F.array_distinct(F.split("_whole", "\n"))))
    fit = several.join(lines, ["_id", "_line"]).where(all_there).groupBy("_h").agg(F.min(F.struct(F.length("_whole"), "_whole")).alias("w"))
    out = found.union(fit.select("_h", "w._whole"))
    return scratch.keep(out.select(F.xxhash64("_h").alias("key"), "_h", F.col("_whole").alias("text")), "originals")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id (nulls last) of each group linked by five-word similarity 0.8 or more.

    Documents link if their texts are similar. Where sf_dir has the documents whose lines the line stage cut, these link too if their whole
    texts are: a near copy has lost the lines that it shares with the document it resembles, so that what is left of it may resemble nothing.
    SimHash fingerprints give the first links; those that 64 bits can't find follow by an exact search. Texts without
    words are one group. Rows that agree in all columns are one document; of rows with one id and text
    that differ elsewhere, the one with the smallest hash stays.
    """
    small_batches(spark)
    docs = take(docs, *COLUMNS).withColumn("_h", F.xxhash64(*COLUMNS))
    texts, ties = docs.select(F.col("_h").alias("key"), "text"), None
    if sf_dir and (whole := _originals(spark, docs, sf_dir)) is not None:
        texts, ties = texts.union(whole.select("key", "text")), whole.select("key", F.col("_h").alias("other"))
    roots = resemblance.groups(texts, ties=ties)
    ends = docs.select("doc_id", "_h").join(roots.distinct(), F.col("_h") == F.col("key"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_h"))
    kept = cut(ends.groupBy("root").agg(first.alias("low")).select("low._h"))
    return docs.join(kept, "_h", "left_semi").dropDuplicates(["_h"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take words of each source up to its target; a document has a row for each round that takes words of it."""
    small_batches(spark)
    return _counted(mixing.mix_documents(docs, COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' ids into sequences of 2048; returns a row for each piece."""
    small_batches(spark)
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL can't express the trained network, so neither the stages after it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result but the last is written to the shared folder and read again."""
    import uuid

    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
