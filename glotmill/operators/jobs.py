"""Jobs: identity, stages and their reuse, gates, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotmill import fixed
from glotmill.functions.text import is_blank


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON of the fields in order of their names, with nulls."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def fingerprint(fields: dict[str, Column]) -> Column:
    """The SHA-256 of canonical_json()."""
    return F.sha2(canonical_json(fields), 256)


def identities(units: DataFrame, job: str, *fields: str) -> DataFrame:
    """(job, units, identity): a digest of all units of a job, whatever their order or partitions.

    The units' digests are added up, so that no job is gathered into one row. Repeated units count.
    """
    digest = F.md5(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in fields]))
    part = lambda i: F.sum(F.conv(F.substring(digest, i, 12), 16, 10).cast("decimal(38,0)"))
    sums = units.groupBy(job).agg(F.count("*").alias("units"), part(1).alias("_a"), part(13).alias("_b"))
    return sums.select(job, "units", F.md5(F.concat_ws(":", "units", "_a", "_b")).alias("identity"))


def foreign(worklist: DataFrame, jobs: DataFrame, job: str) -> DataFrame:
    """Rows of worklist(job, identity, ...) whose identity isn't the job's, or whose job is unknown."""
    known = jobs.select(job, F.col("identity").alias("_identity"))
    rows = worklist.join(known, job, "left")
    return rows.where(~F.coalesce(F.col("identity") == F.col("_identity"), F.lit(False))).drop("_identity")


def reusable(stages: DataFrame, wanted: DataFrame, outputs: DataFrame) -> DataFrame:
    """(job, stage, reuse): whether a stage of wanted(job, stage, input_key) can be kept.

    It can if stages(job, stage, input_key, output_sha256) has it for the same input and outputs(job, stage, sha256) still is what it made.
    """
    done = stages.select("job", "stage", "input_key", "output_sha256").distinct()
    rows = wanted.join(done, ["job", "stage", "input_key"], "left").join(outputs, ["job", "stage"], "left")
    return rows.groupBy("job", "stage").agg(F.bool_or(F.coalesce(F.col("output_sha256") == F.col("sha256"), F.lit(False))).alias("reuse"))


def status(jobs: DataFrame) -> DataFrame:
    """(job, status) of jobs(job, pending, images_pending, failed, delivered): open work comes before an old delivery."""
    says = (
        F.when(F.col("failed"), "failed").when(F.col("pending") > 0, "translate").when(F.col("images_pending") > 0, "images")
        .when(F.col("delivered"), "delivered").otherwise("ready")
    )
    return jobs.select("job", says.alias("status"))


def configuration_errors(jobs: DataFrame, modes: tuple[str, ...] = ("monolingual", "bilingual")) -> DataFrame:
    """(job, error) of jobs(job, source_sha256, target_language, output_mode)."""
    rules = F.array(
        F.when(~F.coalesce(F.col("source_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest"),
        F.when(is_blank(F.col("target_language")), "language"),
        F.when(~F.coalesce(F.col("output_mode").isin(*modes), F.lit(False)), "mode"),
    )
    return jobs.select("job", F.explode(F.array_compact(rules)).alias("error"))


def deliverable(stages: DataFrame) -> DataFrame:
    """(job, deliver) of stages(job, rendered, reviewed, renderable): rendered, and reviewed unless nothing could be rendered."""
    return stages.select("job", (F.col("rendered") & (F.col("reviewed") | (F.col("renderable") == 0))).alias("deliver"))


def new_errors(output: DataFrame, baseline: DataFrame, mapping: DataFrame) -> DataFrame:
    """Errors (key, error) of the output that the baseline doesn't have at the key that mapping(key, new_key) leads to."""
    moved = baseline.join(mapping, "key").select(F.col("new_key").alias("key"), "error")
    return output.join(moved, ["key", "error"], "left_anti")


def protected_removed(removed: DataFrame, protected: DataFrame) -> DataFrame:
    """Parts that are to be removed though they are protected; an empty result allows the removal."""
    return removed.select("part").intersect(protected.select("part"))


def batch(batches: DataFrame, number: int) -> DataFrame:
    """The rows of the batch with a number from 1 on; an error if there is none."""
    top = batches.agg(F.max("batch")).first()[0] or 0
    if not 1 <= number <= top:
        raise ValueError(f"no batch {number} among {top}")
    return batches.where(F.col("batch") == number)


def first_and_rest(rows: DataFrame, by: str, order: str, n: int = 4) -> DataFrame:
    """(by, shown, rest): the first n of each group in order, and how many more there are.

    Rows are ranked in a window and only n of them gathered.
    """
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    return ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.col("_r") <= n, F.col(order)))).alias("shown"), F.greatest(F.lit(0), F.count("*") - n).alias("rest"))


def message(rows: DataFrame, by: str, example: str, n: int = 8) -> DataFrame:
    """(by, message): the first n distinct examples in order, joined by commas."""
    each = rows.select(by, example).distinct()
    return first_and_rest(each, by, example, n).select(by, F.array_join("shown", ", ").alias("message"))


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    """How many rows each combination of values has."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"))


def write_order(items: DataFrame, target: str, paragraph: str) -> DataFrame:
    """items with `step`: within a target the last paragraph is written first, so that earlier ordinals stay true."""
    return items.withColumn("step", F.row_number().over(Window.partitionBy(target).orderBy(F.desc(paragraph))))


def forced_retentions(units: DataFrame, occurrences: DataFrame) -> DataFrame:
    """units(id, status, reason) with those retained that a formula depends on, by occurrences(unit_id, formula_dependency)."""
    needed = occurrences.groupBy("unit_id").agg(F.bool_or("formula_dependency").alias("_f")).where("_f")
    rows = units.join(needed, F.col("id") == F.col("unit_id"), "left")
    force = F.coalesce("_f", F.lit(False))
    return rows.select("id", F.when(force, "retain").otherwise(F.col("status")).alias("status"), F.when(force, "formula depends on the text").otherwise(F.col("reason")).alias("reason"))


def unit_of(occurrences: DataFrame, units: DataFrame) -> DataFrame:
    """occurrences(id, unit_id, ...) with their unit's translation, and `error` where the unit is unknown or its source differs."""
    known = units.select(F.col("id").alias("unit_id"), F.col("source").alias("_source"), "translation")
    rows = occurrences.join(known, "unit_id", "left")
    error = F.when(F.col("_source").isNull(), "unknown unit").when(F.col("_source") != F.col("source"), "other source")
    return rows.withColumn("error", error).drop("_source")


def next_stage(done: DataFrame, job: str = "job", stage: str = "stage") -> DataFrame:
    """(job, next): the first stage in order that a job hasn't done; null if all are."""
    names = F.array(*map(F.lit, fixed.STAGES))
    got = done.groupBy(job).agg(F.collect_set(stage).alias("_d"))
    return got.select(job, F.get(F.filter(names, lambda s: ~F.array_contains("_d", s)), 0).alias("next"))
