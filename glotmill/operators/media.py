"""Pictures of packages: groups of equal ones, hosts, replacement plans, decisions, overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotmill.functions.text import is_blank


def merge_images(images: DataFrame) -> DataFrame:
    """One row for each digest of images(id, sha256, occurrences, status): the smallest id, all places once and in order,
    and whether any of the rows asks for a manual review, which the merged one then keeps."""
    places = images.groupBy("sha256").agg(F.min("id").alias("id"), F.bool_or(F.col("status") == "manual_review").alias("manual_review"), F.count("*").alias("merged"))
    each = images.select("sha256", F.explode_outer("occurrences").alias("_o")).distinct()
    lists = each.groupBy("sha256").agg(F.array_sort(F.collect_list("_o")).alias("occurrences"))
    return places.join(lists, "sha256").select("id", "sha256", "occurrences", "manual_review", "merged")


def hosts(media: DataFrame, relations: DataFrame, anchors: DataFrame) -> DataFrame:
    """(part, owner, kind) of media(part): the drawings that show it, by relations(owner, rid, target) and
    anchors(owner, rid, kind: inline or anchor). A part that no drawing shows has null owner and kind."""
    shown = relations.join(anchors, ["owner", "rid"]).select(F.col("target").alias("part"), "owner", "kind").distinct()
    return media.select("part").join(shown, "part", "left")


def _suffix(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(\.[^./]+)$", 1))


def replacement_errors(plan: DataFrame, files: DataFrame) -> DataFrame:
    """(part, path, error) for every rule that a row of plan(part, path, sha256) breaks; files(path, sha256) are those at hand.

    The file exists, it has the digest that was reviewed, its suffix is the part's, and a part is claimed once.
    """
    claims = plan.groupBy("part").agg(F.count("*").alias("_n"))
    rows = plan.join(files.select("path", F.col("sha256").alias("_have")), "path", "left").join(claims, "part")
    rules = F.array(
        F.when(F.col("_have").isNull(), "file missing"),
        F.when(F.col("_have").isNotNull() & ~F.col("_have").eqNullSafe(F.col("sha256")), "digest differs"),
        F.when(_suffix(F.col("part")) != _suffix(F.col("path")), "other suffix"),
        F.when(F.col("_n") > 1, "part claimed twice"),
    )
    return rows.select("part", "path", F.explode(F.array_compact(rules)).alias("error"))


def not_replaced(expected: DataFrame, output: DataFrame) -> DataFrame:
    """(part, error) of expected(part, source_sha256, target_sha256) against output(part, sha256)."""
    got = expected.join(output.select("part", F.col("sha256").alias("_got")), "part", "left")
    error = (
        F.when(F.col("_got").isNull(), "part missing").when(F.col("_got") == F.col("target_sha256"), None)
        .when(F.col("_got") == F.col("source_sha256"), "still the source").otherwise("unknown picture")
    )
    return got.select("part", error.alias("error")).where("error IS NOT NULL")


def pending(images: DataFrame, errors: DataFrame) -> DataFrame:
    """Undecided pictures of images(id, decision), and decided ones that errors(id, error) opens again."""
    rows = images.join(errors, "id", "left")
    return rows.where(is_blank(F.col("decision")) | F.col("error").isNotNull()).select("id", "decision", "error")


def merge_decisions(images: DataFrame, decisions: DataFrame) -> DataFrame:
    """images(id, decision, reason, reason_code) after decisions of the same columns; a new one clears the old reason."""
    new = decisions.select("id", *[F.col(c).alias(f"_{c}") for c in ("decision", "reason", "reason_code")])
    decided = F.col("_decision").isNotNull()
    keeps = ~F.coalesce(F.col("_decision") == "replace", F.lit(False))
    out = {"decision": F.coalesce("_decision", "decision")}
    out |= {c: F.when(decided, F.when(keeps, F.col(f"_{c}"))).otherwise(F.col(c)) for c in ("reason", "reason_code")}
    return images.join(new, "id", "left").select("id", *[v.alias(k) for k, v in out.items()])


def overlay_errors(overlays: DataFrame) -> DataFrame:
    """(image, id, error) of overlays(image, id, x, y, w, h, host_w, host_h, label_bottom).

    Geometry is finite, of positive size, inside the host and below the label that it translates; an id stands in one picture only.
    """
    numbers = ("x", "y", "w", "h")
    finite = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in numbers])
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("w") <= F.col("host_w")) & (F.col("y") + F.col("h") <= F.col("host_h"))
    shared = overlays.groupBy("id").agg(F.count_distinct("image").alias("_n"))
    geometry = F.when(~finite, "not finite").when((F.col("w") <= 0) | (F.col("h") <= 0), "empty").when(~inside, "outside its host").when(F.col("y") < F.col("label_bottom"), "above its label")
    found = F.array_compact(F.array(geometry, F.when(F.col("_n") > 1, "id in several pictures")))
    return overlays.join(shared, "id").select("image", "id", F.explode(found).alias("error"))
