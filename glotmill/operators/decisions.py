"""Decisions of translators: merging, rejection, coverage, summaries, stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotmill import fixed
from glotmill.functions.text import is_blank


def judge(decisions: DataFrame, units: DataFrame, error: Column | None = None) -> DataFrame:
    """Each decision (unit_id, source, translation, status) with `outcome` and `problem`.

    Both tables key on unit_id. A blank pending decision is no decision. A repeated id rejects all its copies; then an unknown id, a
    changed source echo and `error` (over the joined columns, units' as u_*) reject. The rest are accepted.
    """
    given = decisions.where(~(is_blank(F.col("translation")) & (F.coalesce("status", F.lit("pending")) == "pending")))
    times = given.groupBy("unit_id").agg(F.count("*").alias("_times"))
    known = units.select(F.col("unit_id"), *[F.col(c).alias(f"u_{c}") for c in units.columns if c != "unit_id"], F.lit(True).alias("_known"))
    joined = given.join(times, "unit_id").join(known, "unit_id", "left")
    problem = F.coalesce(
        F.when(F.col("_times") > 1, "duplicate id"), F.when(F.col("_known").isNull(), "unknown id"),
        F.when(F.col("source") != F.col("u_source"), "source changed"), F.lit(None).cast("string") if error is None else error,
    )
    return joined.withColumn("problem", problem).withColumn("outcome", F.when(F.col("problem").isNull(), "accepted").otherwise("rejected")).drop("_times", "_known")


def merge(units: DataFrame, judged: DataFrame) -> DataFrame:
    """units with accepted decisions applied; rejected and missing ones leave what was accepted before."""
    new = judged.where("outcome = 'accepted'").select("unit_id", F.col("translation").alias("_t"), F.col("status").alias("_s"))
    merged = units.join(new, "unit_id", "left")
    return merged.withColumns({"translation": F.coalesce("_t", "translation"), "status": F.coalesce("_s", "status")}).drop("_t", "_s")


def summary(judged: DataFrame, by: list[str]) -> DataFrame:
    """accepted, rejected and their reasons in number, by group."""
    return judged.groupBy(*by).agg(
        F.count_if(F.col("outcome") == "accepted").alias("accepted"), F.count_if(F.col("outcome") == "rejected").alias("rejected"),
        F.count_if(F.col("problem") == "duplicate id").alias("duplicates"), F.count_if(F.col("problem") == "unknown id").alias("unknown"),
    )


def orphans(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of left without a partner."""
    return left.join(right.select(on).distinct(), on, "left_anti")


def stage_progress(done: DataFrame, job: str, stage: str, order: Column) -> DataFrame:
    """For each job the completed stages, whether each came after all earlier ones, and the first that is missing.

    Repeated completions count once, at their first time.
    """
    stages = [F.lit(s) for s in fixed.STAGES]
    at = F.array_position(F.array(*stages), F.col(stage)).cast("int")
    firsts = done.withColumn("_n", at).where("_n > 0").groupBy(job, "_n").agg(F.min(order).alias("_t"))
    w = Window.partitionBy(job).orderBy("_t", "_n")
    seen = firsts.withColumn("_place", F.row_number().over(w))
    out = seen.groupBy(job).agg(F.count("*").alias("completed"), F.bool_and(F.col("_place") == F.col("_n")).alias("in_order"), F.collect_set("_n").alias("_all"))
    missing = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(len(stages))), "_all"))
    return out.withColumn("next_stage", F.get(F.array(*stages), missing - 1)).drop("_all")


def invalidate(stages: DataFrame, job: str, stage: str, source: Column) -> DataFrame:
    """stages without the given stage of a job and everything downstream of it."""
    order = F.array(*[F.lit(s) for s in fixed.STAGES])
    return stages.where(F.array_position(order, F.col(stage)) < F.array_position(order, source))


def first_per_rule(findings: DataFrame, job: str, order: list[str]) -> DataFrame:
    """The first finding of each job, in document order (fail fast)."""
    w = Window.partitionBy(job).orderBy(*order)
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
