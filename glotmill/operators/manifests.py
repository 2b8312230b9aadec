"""Rules of a workbook job's manifest, as tables: every broken rule is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotmill.functions import quality
from glotmill.functions.text import is_blank, retention_error
from glotmill.operators.snapshots import reasons

#: The attributes that an occurrence has in common with its unit.
SHARED = ("source", "context_key", "protected_tokens")


def _no_digest(c: Column) -> Column:
    return F.coalesce(F.length(c) != 64, F.lit(True))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows(job, position, id, ...) with `repeated`: whether an earlier row of the job has the id. Blank ids repeat nothing."""
    first = rows.where(~is_blank(F.col("id"))).groupBy("job", "id").agg(F.min("position").alias("_first"))
    return rows.join(first, ["job", "id"], "left").withColumn("repeated", F.coalesce(F.col("position") > F.col("_first"), F.lit(False))).drop("_first")


def _report(rows: DataFrame, part: str, checks: list[tuple[Column, str]]) -> DataFrame:
    return rows.select("job", F.lit(part).alias("part"), "position", F.explode(reasons(checks)).alias("rule"))


def _blank(*names: str) -> list[tuple[Column, str]]:
    return [(is_blank(F.col(n)), f"{n} is blank") for n in names]


def job_errors(jobs: DataFrame) -> DataFrame:
    """Of jobs(job, source_file, target_language, output_mode, source_sha256)."""
    mode = ~F.coalesce(F.col("output_mode").isin("monolingual", "bilingual"), F.lit(False))
    checks = [*_blank("source_file", "target_language", "output_mode"), (_no_digest(F.col("source_sha256")), "source_sha256 is no digest"), (mode, "output_mode is unknown")]
    return _report(jobs.withColumn("position", F.lit(0).cast("long")), "job", checks)


def unit_errors(units: DataFrame) -> DataFrame:
    """Of units(job, position, id, source, context_key, protected_tokens, translation, status, reason)."""
    source, target, status = F.col("source"), F.col("translation"), F.col("status")
    tokens = F.coalesce("protected_tokens", F.array().cast("array<string>"))
    sheet = F.coalesce(F.col("context_key") == "sheet:name", F.lit(False))
    changed = F.when(sheet, quality.sheet_numbers_lost(source, target)).otherwise(quality.technical_lost(source, target, tokens))
    checks = [
        (is_blank(F.col("id")) | F.col("repeated"), "id is missing or repeated"),
        *_blank("source", "context_key"),
        (F.col("protected_tokens").isNull(), "protected_tokens is no list"),
        ((status == "translated") & is_blank(target), "translation is missing"),
        ((status == "retain") & is_blank(F.col("reason")), "reason is missing"),
        ((status == "retain") & ~target.eqNullSafe(source) | (status == "retain") & target.isNull(), "retained text differs from source"),
        (~F.coalesce(status.isin("translated", "retain"), F.lit(False)), "status is unknown"),
        (source.isNotNull() & target.isNotNull() & changed, "technical values changed"),
    ]
    return _report(_numbered(units), "unit", checks)


def occurrence_errors(occurrences: DataFrame, units: DataFrame) -> DataFrame:
    """Of occurrences(job, position, id, kind, sheet, address, source, context_key, protected_tokens, translation_unit_id).

    An occurrence belongs to the first unit of its job with that id and agrees with it in SHARED.
    """
    known = _numbered(units).where(~is_blank(F.col("id")) & ~F.col("repeated")).dropDuplicates(["job", "id"])
    known = known.select("job", F.col("id").alias("translation_unit_id"), F.lit(True).alias("known"), *[F.col(n).alias(f"unit_{n}") for n in SHARED])
    rows = _numbered(occurrences).join(known, ["job", "translation_unit_id"], "left")
    checks = [
        (is_blank(F.col("id")) | F.col("repeated"), "id is missing or repeated"),
        *_blank("kind", "sheet", "address", "source", "context_key"),
        (F.col("protected_tokens").isNull(), "protected_tokens is no list"),
        (F.col("known").isNull(), "translation_unit_id is unknown"),
        *[(F.col("known") & ~F.col(n).eqNullSafe(F.col(f"unit_{n}")), f"{n} differs from its unit") for n in SHARED],
    ]
    return _report(rows, "occurrence", checks)


def image_errors(images: DataFrame) -> DataFrame:
    """Of images(job, position, id, sha256, occurrences, status, reason, reason_code, replacement_path, replacement_sha256)."""
    status, places = F.col("status"), F.col("occurrences")
    located = places.isNotNull() & (F.size(places) > 0) & ~F.exists(places, is_blank)
    checks = [
        (is_blank(F.col("id")) | F.col("repeated"), "id is missing or repeated"),
        (_no_digest(F.col("sha256")), "sha256 is no digest"),
        (~F.coalesce(located, F.lit(False)), "occurrences are missing"),
        (retention_error(status, F.col("reason"), F.col("reason_code")).isNotNull(), "retention is not justified"),
        (status == "manual-review", "manual review is open"),
        (~F.coalesce(status.isin("manual-review", "reviewed", "localized", "retain"), F.lit(False)), "status is unknown"),
        ((status == "localized") & (is_blank(F.col("replacement_path")) | _no_digest(F.col("replacement_sha256"))), "replacement is missing"),
    ]
    return _report(_numbered(images), "image", checks)


def errors(jobs: DataFrame, units: DataFrame, occurrences: DataFrame, images: DataFrame) -> DataFrame:
    """(job, part, position, rule): all broken rules of all jobs. Nulls count as missing; an empty table breaks none."""
    return job_errors(jobs).union(unit_errors(units)).union(occurrence_errors(occurrences, units)).union(image_errors(images))
