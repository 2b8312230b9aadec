from glotmill.operators import manifests

JOB = "job string, source_file string, target_language string, output_mode string, source_sha256 string"
UNIT = "job string, position long, id string, source string, context_key string, protected_tokens array<string>, translation string, status string, reason string"
PLACE = "job string, position long, id string, kind string, sheet string, address string, source string, context_key string, protected_tokens array<string>, translation_unit_id string"
IMAGE = "job string, position long, id string, sha256 string, occurrences array<string>, status string, reason string, reason_code string, replacement_path string, replacement_sha256 string"
DIGEST = "a" * 64


def test_manifest_rules(spark):
    jobs = spark.createDataFrame([("j", "a.xlsx", "en", "monolingual", DIGEST), ("k", " ", "en", "both", None)], JOB)
    units = [
        ("j", 0, "u", "功率 45 kW", "cell", [], "Power 45 kW", "translated", None),
        ("j", 1, "u", "泵", "cell", [], "", "translated", None),
        ("j", 2, "v", "泵", "cell", None, "Pump", "retain", " "),
        ("j", 3, "w", "功率 45 kW", "cell", [], "Power 46 kW", "translated", None),
        ("j", 4, None, None, "", [], None, "pending", None),
        ("j", 5, "n", "表 2", "sheet:name", [], "Sheet", "translated", None),
    ]
    places = [
        ("j", 0, "o", "cell", "S", "A1", "功率 45 kW", "cell", [], "u"),
        ("j", 1, "o", "cell", "S", "A2", "泵", "cell", [], "u"),
        ("j", 2, "p", "cell", None, "A3", "泵", "cell", [], "x"),
        ("k", 0, "o", "cell", "S", "A1", "功率 45 kW", "cell", [], "u"),
    ]
    images = [
        ("j", 0, "i", DIGEST, ["S!A1"], "localized", None, None, "b.png", DIGEST),
        ("j", 1, "i", "short", [], "localized", None, None, "b.png", None),
        ("j", 2, "l", DIGEST, [""], "manual-review", None, None, None, None),
        ("j", 3, "m", DIGEST, ["S!A1"], None, None, None, None, None),
        ("j", 4, "r", DIGEST, ["S!A1"], "retain", None, None, None, None),
    ]
    units, places, images = (spark.createDataFrame(r, s) for r, s in ((units, UNIT), (places, PLACE), (images, IMAGE)))
    got = sorted(tuple(r) for r in manifests.errors(jobs, units, places, images).collect())
    assert got == sorted(
        [("k", "job", 0, r) for r in ("source_file is blank", "source_sha256 is no digest", "output_mode is unknown")]
        + [("j", "unit", 1, r) for r in ("id is missing or repeated", "translation is missing")]
        + [("j", "unit", 2, r) for r in ("protected_tokens is no list", "reason is missing", "retained text differs from source")]
        + [("j", "unit", 3, "technical values changed"), ("j", "unit", 5, "technical values changed")]
        + [("j", "unit", 4, r) for r in ("id is missing or repeated", "source is blank", "context_key is blank", "status is unknown")]
        + [("j", "occurrence", 1, r) for r in ("id is missing or repeated", "source differs from its unit")]
        + [("j", "occurrence", 2, r) for r in ("sheet is blank", "translation_unit_id is unknown")]
        + [("k", "occurrence", 0, "translation_unit_id is unknown")]
        + [("j", "image", 1, r) for r in ("id is missing or repeated", "sha256 is no digest", "occurrences are missing", "replacement is missing")]
        + [("j", "image", 2, r) for r in ("occurrences are missing", "manual review is open")]
        + [("j", "image", 3, "status is unknown"), ("j", "image", 4, "retention is not justified")]
    )
    none = manifests.errors(jobs.limit(0), units.limit(0), places.limit(0), images.limit(0))
    assert none.collect() == [] and none.columns == ["job", "part", "position", "rule"]
