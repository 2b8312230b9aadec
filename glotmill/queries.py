"""The registered queries of the localization operators on the test tables, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glotmill import fixed
from glotmill.functions import quality
from glotmill.functions import text as T
from glotmill.operators import batches, decisions, formulas, glossary, grids, jobs, media, snapshots, units
from glotmill.sources import office

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINES = """
lines AS (
  SELECT doc_id, source, i AS ord, line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents), unnest(a) WITH ORDINALITY AS t(line, i)
  WHERE regexp_replace(line, '\\s+', '', 'g') <> '')"""


@_query(f"""WITH {_LINES} SELECT doc_id, ord::INTEGER AS ord, line AS source,
  coalesce(right(lag(line) OVER w, 160), '') AS before, coalesce(left(lead(line) OVER w, 160), '') AS after, sha256(line) AS sha256
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY ord)""")
def line_occurrences(spark, sf_dir):
    """Located lines with their context."""
    return units.line_occurrences(_table(spark, sf_dir, "documents"))


@_query(f"""WITH {_LINES} SELECT 'tu-' || left(sha256(line), 16) AS unit_id, line AS source, count(*) AS occurrence_count,
  min(doc_id * 1000000 + ord) AS first_seen FROM lines GROUP BY line""")
def translation_units(spark, sf_dir):
    """A1: equal lines as one unit, in first-seen order."""
    occ = units.line_occurrences(_table(spark, sf_dir, "documents"))
    return units.translation_units(occ, ["source"], F.col("doc_id") * 1_000_000 + F.col("ord"))


@_query("""WITH RECURSIVE d AS (
  SELECT source, doc_id // 1000 AS part, doc_id, greatest(n_chars, 1) AS cost, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) AS rn FROM documents),
r AS (
  SELECT source, part, doc_id, rn, 1 AS batch_index, cost AS size FROM d WHERE rn = 1
  UNION ALL
  SELECT d.source, d.part, d.doc_id, d.rn, CASE WHEN r.size + d.cost > 24000 THEN r.batch_index + 1 ELSE r.batch_index END,
         CASE WHEN r.size + d.cost > 24000 THEN d.cost ELSE r.size + d.cost END
  FROM r JOIN d ON d.source = r.source AND d.part = r.part AND d.rn = r.rn + 1)
SELECT source, part, doc_id, batch_index FROM r""")
def greedy_batches(spark, sf_dir):
    """Documents of each job (a source's thousand ids) packed greedily into batches of 24,000 characters."""
    docs = _table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 1000).alias("part"), "doc_id", "n_chars")
    return batches.greedy_batches(docs, ["source", "part"], "doc_id", "n_chars").select("source", "part", "doc_id", "batch_index")


@_query("""SELECT sha256(text) AS sha256, count(*) AS locations, min(doc_id) AS first_key, max(doc_id) AS last_key, count(DISTINCT source) AS places FROM documents GROUP BY 1""")
def content_groups(spark, sf_dir):
    """A2: documents with equal content."""
    return units.content_groups(_table(spark, sf_dir, "documents"), "text", "doc_id", "source")


def _pairs(spark, sf_dir) -> DataFrame:
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    return _table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("Size "), "p_size", F.lit(" price "), price).alias("source"),
        F.concat(F.lit("Maße "), F.col("p_size") + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0), F.lit(" Preis "), price).alias("target"),
    )


_PAIRS = """
p AS (SELECT p_partkey, 'Size ' || p_size || ' price ' || p_retailprice::DECIMAL(12,2) AS source,
  'Maße ' || (p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END) || ' Preis ' || p_retailprice::DECIMAL(12,2) AS target FROM part)"""


@_query(f"""WITH {_PAIRS},
s AS (SELECT p_partkey, unnest(regexp_extract_all(source, '[0-9]+(?:[.][0-9]+)?')) AS number FROM p),
t AS (SELECT p_partkey, unnest(regexp_extract_all(target, '[0-9]+(?:[.][0-9]+)?')) AS number FROM p)
SELECT p_partkey, number, count(*) AS missing FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM t) GROUP BY ALL""")
def number_bag_mismatch(spark, sf_dir):
    """Numbers that a source has more often than its target."""
    p = _pairs(spark, sf_dir)
    side = lambda c: p.select("p_partkey", F.explode(T.numbers(F.col(c))).alias("number"))
    return snapshots.bag_difference(side("source"), side("target"), ["p_partkey"], "number")


@_query(f"""SELECT doc_id, token, count(*) AS times FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '(?i){fixed.TOKEN_PATTERNS['plain']}')) AS token FROM documents) GROUP BY ALL""")
def protected_tokens(spark, sf_dir):
    """Protected tokens of documents (the pattern without look-around)."""
    tokens = T.protected_tokens(F.col("text"), "plain")
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("times"))


def _decisions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Labels as decisions: some ids twice, some unknown, some with a changed source echo, some blank."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), F.left("text", F.lit(20)).alias("source"), F.lit("").alias("translation"), F.lit("pending").alias("status"))
    made = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).join(docs.select("unit_id", "source"), F.col("doc_id") == F.col("unit_id"))
    base = made.select(
        "unit_id", F.when(F.col("unit_id") % 11 == 0, "?").otherwise(F.col("source")).alias("source"),
        F.when(F.col("unit_id") % 13 == 0, "").otherwise(F.concat(F.lit("t"), "unit_id")).alias("translation"), F.when(F.col("quality") == 1, "translated").otherwise("pending").alias("status"),
    )
    unknown = base.where("unit_id % 7 = 0").withColumn("unit_id", -F.col("unit_id") - 1)
    return docs, base.union(base.where("unit_id % 17 = 0")).union(unknown)


_DECISIONS = """
docs AS (SELECT doc_id AS unit_id, left(text, 20) AS source FROM documents),
base AS (
  SELECT unit_id, CASE WHEN unit_id % 11 = 0 THEN '?' ELSE source END AS source, CASE WHEN unit_id % 13 = 0 THEN '' ELSE 't' || unit_id END AS translation,
         CASE WHEN q = 1 THEN 'translated' ELSE 'pending' END AS status
  FROM (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l JOIN docs ON unit_id = doc_id),
given AS (
  SELECT * FROM (SELECT * FROM base UNION ALL SELECT * FROM base WHERE unit_id % 17 = 0 UNION ALL SELECT -unit_id - 1, source, translation, status FROM base WHERE unit_id % 7 = 0)
  WHERE NOT (translation = '' AND status = 'pending')),
judged AS (
  SELECT g.*, CASE WHEN count(*) OVER (PARTITION BY g.unit_id) > 1 THEN 'duplicate id' WHEN d.unit_id IS NULL THEN 'unknown id' WHEN g.source <> d.source THEN 'source changed'
    WHEN g.translation = '' THEN 'translation required' END AS problem
  FROM given g LEFT JOIN docs d ON d.unit_id = g.unit_id)"""


def _judged(spark, sf_dir) -> DataFrame:
    docs, made = _decisions(spark, sf_dir)
    return decisions.judge(made, docs, F.when(T.is_blank(F.col("translation")), "translation required"))


@_query(f"""WITH {_DECISIONS} SELECT unit_id, translation, CASE WHEN problem IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome, problem FROM judged""")
def decision_merge(spark, sf_dir):
    """Decisions accepted or rejected with the first reason."""
    return _judged(spark, sf_dir).select("unit_id", "translation", "outcome", "problem")


@_query(f"""WITH {_DECISIONS} SELECT d.unit_id, coalesce(j.translation, '') AS translation, coalesce(j.status, 'pending') AS status
  FROM docs d LEFT JOIN (SELECT * FROM judged WHERE problem IS NULL) j USING (unit_id)""")
def decisions_applied(spark, sf_dir):
    """Units with the accepted decisions applied."""
    docs, _ = _decisions(spark, sf_dir)
    return decisions.merge(docs, _judged(spark, sf_dir)).select("unit_id", "translation", "status")


@_query(f"""WITH {_DECISIONS} SELECT status, count(*) FILTER (WHERE problem IS NULL) AS accepted, count(*) FILTER (WHERE problem IS NOT NULL) AS rejected,
  count(*) FILTER (WHERE problem = 'duplicate id') AS duplicates, count(*) FILTER (WHERE problem = 'unknown id') AS unknown FROM judged GROUP BY status""")
def decision_summary(spark, sf_dir):
    """Outcomes in number."""
    return decisions.summary(_judged(spark, sf_dir), ["status"])


@_query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_check(spark, sf_dir):
    """Documents without a label."""
    return decisions.orphans(_table(spark, sf_dir, "documents").select("doc_id", "source"), _table(spark, sf_dir, "labels"), "doc_id")


@_query("""SELECT doc_id, item_id, strpos(d.text, b.text)::INTEGER AS "offset" FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def passage_match(spark, sf_dir):
    """Passages that documents contain, with the place."""
    return glossary.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


_TERMS = (("the", "der"), ("and the", "und die"), ("with", "mit"), ("que", "dass"), ("von der", "of the"), ("licensed under", "lizenziert"))


_GLOSSARY = ["| source | target |", "|-|-|", *(f"| {a} | {b} |" for a, b in _TERMS), f"| {_TERMS[0][0]} | {_TERMS[0][1]} |", "no row", "| alone |"]


@_query(f"""WITH terms(term, target) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _TERMS)}),
t AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT term AS source, target, count(DISTINCT doc_id) AS texts, min(doc_id) AS first_text, false AS exact
FROM t JOIN terms ON regexp_matches(t, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY ALL""")
def glossary_rollup(spark, sf_dir):
    """A glossary table is read, its terms are found in documents and counted."""
    lines = spark.createDataFrame([*enumerate(_GLOSSARY)], "n int, value string")
    entries = glossary.parse_markdown(lines, source="[a-z]", headers=("source",))
    return glossary.rollup(glossary.word_matches(_table(spark, sf_dir, "documents"), entries, "doc_id", "text"), "doc_id")


@_query()
def longest_terms(spark, sf_dir):
    """Longest terms without overlap."""
    found = glossary.longest_terms(F.col("text"), [a for a, _ in _TERMS])
    return _table(spark, sf_dir, "documents").select("doc_id", F.inline(found))


_RANGES = ((1, 3, 10, 120), (5, 40, 9, 400), (20, 1, 30, 60), (49, 100, 50, 1500))


@_query(f"""WITH r(c0, r0, c1, r1) AS (VALUES {", ".join(map(str, _RANGES))})
SELECT p_partkey, p_size AS col, (p_partkey % 2000)::INTEGER AS row FROM part WHERE EXISTS (SELECT 1 FROM r WHERE p_size BETWEEN c0 AND c1 AND p_partkey % 2000 BETWEEN r0 AND r1)""")
def range_cells(spark, sf_dir):
    """Cells that formula ranges hold."""
    cells = _table(spark, sf_dir, "part").select("p_partkey", F.lit("S").alias("sheet"), F.col("p_size").alias("col"), (F.col("p_partkey") % 2000).cast("int").alias("row"))
    ranges = spark.createDataFrame([("S", *r) for r in _RANGES], "sheet string, c0 int, r0 int, c1 int, r1 int")
    return grids.cells_in_ranges(cells, ranges).select("p_partkey", "col", "row")


@_query("""WITH b AS (SELECT doc_id // 1000 AS sheet, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
g AS (SELECT *, doc_id - row_number() OVER (PARTITION BY sheet ORDER BY doc_id) AS run FROM b)
SELECT sheet, min(doc_id) AS first_row, max(doc_id) AS last_row, count(*) AS rows FROM g GROUP BY sheet, run HAVING count(*) >= 3""")
def gap_runs(spark, sf_dir):
    """Runs of three or more blank rows; a row is blank if its document has no label."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels").select("doc_id").distinct()
    rows = docs.join(labels.withColumn("l", F.lit(True)), "doc_id", "left").select(F.floor(F.col("doc_id") / 1000).alias("sheet"), "doc_id", F.col("l").isNull().alias("blank"))
    return grids.blank_runs(rows, "sheet", "doc_id", "blank")


@_query("SELECT DISTINCT s_nationkey AS sheet, unnest(generate_series((s_suppkey % 40)::INTEGER, (s_suppkey % 40 + s_suppkey % 4)::INTEGER))::INTEGER AS row FROM supplier WHERE s_suppkey % 4 > 0")
def merged_rows(spark, sf_dir):
    """Rows that vertical merges cover."""
    r0 = (F.col("s_suppkey") % 40).cast("int")
    merges = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("sheet"), r0.alias("r0"), (r0 + F.col("s_suppkey") % 4).cast("int").alias("r1"))
    return grids.merged_rows(merges)


@_query("SELECT doc_id, (length(text) + length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')))::INTEGER AS weight FROM documents")
def text_weight(spark, sf_dir):
    """Weighted width."""
    return _table(spark, sf_dir, "documents").select("doc_id", T.weight(F.col("text")).alias("weight"))


@_query()
def row_heights(spark, sf_dir):
    """C15, C16 over all rows: wrapped lines and row height of every turn; a null text is an empty cell."""
    lines = T.wrapped_lines(F.coalesce("text", F.lit("")), F.lit(30.0))
    cells = _table(spark, sf_dir, "conversations").select("conv_id", "turn", lines.alias("lines"))
    return cells.withColumn("height", T.row_height(F.col("lines")).cast("double"))


@_query("""SELECT doc_id, CASE WHEN lang = 'en' THEN length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) ELSE 0 END::INTEGER AS hits FROM documents""")
def residual_scan(spark, sf_dir):
    """characters that don't belong to a text's language, in every document."""
    return _table(spark, sf_dir, "documents").select("doc_id", T.residuals(F.col("text"), F.col("lang")).alias("hits"))


@_query("""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM pages""")
def page_text(spark, sf_dir):
    """P2 on markup: text without tags."""
    bare = F.regexp_replace(F.regexp_replace("html", r"<[^>]*>", " "), r"[ \t\n\r]+", " ")
    return _table(spark, sf_dir, "pages").select("page_id", F.trim(bare).alias("text"))


@_query("""SELECT page_id, target, count(*) AS times FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY ALL""")
def page_links(spark, sf_dir):
    """S10 on markup: edges from pages to targets."""
    found = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("target")).groupBy("page_id", "target").agg(F.count("*").alias("times"))


@_query("""WITH p AS (SELECT o_orderkey, (['a.docx', 'B.DOC', 'c.xlsx', 'd.xls', 'e.pptx', 'f.Ppt', 'g.txt', 'none'])[o_orderkey % 8 + 1] AS path FROM orders)
SELECT o_orderkey, CASE WHEN path ILIKE '%.doc%' THEN 'word' WHEN path ILIKE '%.xls%' THEN 'excel' WHEN path ILIKE '%.ppt%' THEN 'ppt' END AS format,
  lower(path) LIKE '%.doc' OR lower(path) LIKE '%.xls' OR lower(path) LIKE '%.ppt' AS convert,
  CASE WHEN path IN ('g.txt', 'none') THEN 'unsupported file type' END AS error FROM p""")
def route_paths(spark, sf_dir):
    """Formats by extension."""
    names = F.array(*map(F.lit, ("a.docx", "B.DOC", "c.xlsx", "d.xls", "e.pptx", "f.Ppt", "g.txt", "none")))
    path = F.get(names, (F.col("o_orderkey") % 8).cast("int"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", office.route(path).alias("r")).select("o_orderkey", "r.*")


@_query("""WITH b AS (SELECT doc_id + CASE WHEN doc_id % 97 = 0 THEN 1000000000 ELSE 0 END AS doc_id, CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END AS text FROM documents)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.text IS NOT DISTINCT FROM b.text THEN 'same' ELSE 'changed' END AS change
FROM documents a FULL JOIN b ON a.doc_id = b.doc_id""")
def snapshot_diff(spark, sf_dir):
    """Documents against a damaged copy."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") + F.when(F.col("doc_id") % 97 == 0, 1_000_000_000).otherwise(0)).alias("doc_id"), F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return snapshots.diff(docs.select("doc_id", F.sha2("text", 256).alias("h")), after.select("doc_id", F.sha2("text", 256).alias("h")), ["doc_id"], "h")


@_query("""SELECT conv_id, (2 * n - 1 + s)::INTEGER AS row, CASE WHEN s = 0 THEN text ELSE upper(role) END AS value
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), (VALUES (0), (1)) AS t(s)""")
def paired_rows(spark, sf_dir):
    """Sources and targets in alternating rows."""
    c = _table(spark, sf_dir, "conversations").withColumn("target", F.upper("role"))
    return units.interleave(c, ["conv_id"], "turn", "text", "target")


_EVENT_STAGE = {"view": "preflight", "click": "inspect", "signup": "prepare", "purchase": "translate", "error": "validate"}


@_query("""WITH e AS (SELECT user_id, list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type) AS n, ts, event_id FROM events),
f AS (SELECT user_id, n, min(epoch_us(ts)) AS t FROM e GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, n) AS place FROM f)
SELECT user_id, count(*) AS completed, bool_and(place = n) AS in_order,
  (['preflight', 'inspect', 'prepare', 'translate', 'validate', 'apply', 'verify', 'office-validate', 'deliver'])[list_min(list_filter(generate_series(1, 9), lambda i: NOT list_contains(list(n), i)))] AS next_stage
FROM p GROUP BY user_id""")
def stage_progress(spark, sf_dir):
    """Stages done, whether in order, and what comes next."""
    name = F.create_map(*[F.lit(x) for kv in _EVENT_STAGE.items() for x in kv])[F.col("event_type")]
    done = _table(spark, sf_dir, "events").select("user_id", name.alias("stage"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return decisions.stage_progress(done, "user_id", "stage", F.col("t"))


@_query("SELECT event_type || ':' || user_id AS message, min(event_id) AS first_seen, count(*) AS times FROM events GROUP BY 1")
def distinct_warnings(spark, sf_dir):
    """A10: each warning once, with where it came first."""
    e = _table(spark, sf_dir, "events").withColumn("message", F.concat_ws(":", "event_type", "user_id"))
    return units.distinct_first(e, "message", F.col("event_id"))


_FILL = "CASE WHEN p_partkey % 6 = 0 THEN p_size || ' x ' || (p_size + 1) || ' mm' WHEN p_partkey % 6 = 1 THEN 'AB' || p_size WHEN p_partkey % 6 = 2 THEN 'PLC' WHEN p_partkey % 6 = 3 THEN '  序  号 ' WHEN p_partkey % 6 = 4 THEN 'Q' ELSE p_name END"


@_query(f"""SELECT p_partkey, {_FILL} AS source, CASE p_partkey % 6 WHEN 0 THEN 'dimension retained' WHEN 1 THEN 'identifier retained' WHEN 2 THEN 'identifier retained'
  WHEN 3 THEN 'fixed label' WHEN 4 THEN 'identifier retained' ELSE CASE WHEN regexp_matches(trim(p_name), '^[A-Za-z0-9./_-]*[0-9][A-Za-z0-9./_-]*$') THEN 'identifier retained' ELSE 'pending' END END AS status FROM part""")
def autofill_status(spark, sf_dir):
    """What needs no translator; dimensions before identifiers before fixed labels."""
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_FILL).alias("source"))
    return rows.withColumn("status", T.autofill(F.col("source")))


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'Power' END AS label, CASE WHEN p_partkey % 3 > 0 THEN p_size || ' kW' END AS suffix,
  CASE WHEN p_partkey % 3 > 0 THEN 'Leistung: ' || p_size || ' kW' ELSE 'Leistung' END AS rendered
FROM (SELECT * FROM part)""".replace("'Leistung: '", "CASE WHEN p_partkey % 3 = 1 THEN 'Leistung:' ELSE 'Leistung：' END"))
def param_template(spark, sf_dir):
    """Labels with technical suffixes split and rendered."""
    k = F.col("p_partkey") % 3
    source = F.when(k == 1, F.concat(F.lit("Power: "), "p_size", F.lit(" kW"))).when(k == 2, F.concat(F.lit(" Power ： "), "p_size", F.lit(" kW "))).otherwise(F.concat(F.lit("Colour: "), "p_type"))
    p = _table(spark, sf_dir, "part").select("p_partkey", T.parameter(source).alias("t"))
    return p.select("p_partkey", "t.label", "t.suffix", T.render(F.col("t"), F.lit("Leistung")).alias("rendered"))


_CODES = ("no_text", "logo_only", "unreadable_text", "because")
_WHAT = ("skip_target", "skip_unclear", "retain", "translate")


@_query(f"""WITH r AS (SELECT o_orderkey, ({list(_WHAT)})[o_orderkey % 4 + 1] AS decision, ({list(_CODES)})[(o_orderkey // 4) % 4 + 1] AS code, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'seen' END AS reason FROM orders)
SELECT o_orderkey, decision, code, CASE WHEN decision = 'translate' THEN NULL WHEN reason = ' ' THEN 'reason missing'
  WHEN decision = 'skip_target' AND code IN ('no_text', 'logo_only') OR decision = 'skip_unclear' AND code = 'unreadable_text' OR decision = 'retain' AND code <> 'because' THEN NULL ELSE 'reason code not allowed' END AS error FROM r""")
def retention_codes(spark, sf_dir):
    """Reasons for keeping pictures as they are."""
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    k = F.col("o_orderkey")
    r = _table(spark, sf_dir, "orders").select("o_orderkey", pick(_WHAT, k % 4).alias("decision"), pick(_CODES, F.floor(k / 4) % 4).alias("code"), F.when(k % 5 == 0, " ").otherwise("seen").alias("reason"))
    return r.select("o_orderkey", "decision", "code", T.retention_error(F.col("decision"), F.col("reason"), F.col("code")).alias("error"))


@_query("""WITH m AS (SELECT user_id, event_type, arg_max(round(value * 100)::BIGINT, event_id) AS v FROM events GROUP BY ALL)
SELECT user_id, count(*) AS stages, sum(v)::BIGINT AS total FROM m GROUP BY user_id""")
def timing_merge(spark, sf_dir):
    """Later timings of a stage replace earlier ones; the total is over what is left."""
    last = F.max_by(F.round(F.col("value") * 100).cast("long"), "event_id")
    return _table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(last.alias("v")).groupBy("user_id").agg(F.count("*").alias("stages"), F.sum("v").alias("total"))


@_query("""SELECT p_partkey, (p_partkey % 18278 + 1)::INTEGER AS col, p_size AS row,
  (CASE WHEN c > 702 THEN chr((65 + (c - 703) // 676 % 26)::INTEGER) ELSE '' END) || (CASE WHEN c > 26 THEN chr((65 + (c - 27) // 26 % 26)::INTEGER) ELSE '' END) || chr((65 + (c - 1) % 26)::INTEGER) || p_size AS address
FROM (SELECT *, p_partkey % 18278 + 1 AS c FROM part)""")
def cell_addresses(spark, sf_dir):
    """Numbers to addresses and back."""
    p = _table(spark, sf_dir, "part").select("p_partkey", F.concat(T.column_letters(F.col("p_partkey") % 18278 + 1), "p_size").alias("address"))
    return p.withColumn("a", T.cell(F.col("address"))).select("p_partkey", "a.col", "a.row", "address")


@_query("""SELECT p_partkey, p_brand, CASE WHEN p_size % 3 = 0 THEN 'Area ' || p_size || ' m² of' WHEN p_size % 3 = 1 THEN 'Flow ' || p_size || ' Nm³/h' ELSE 'Code Xm3 is' END AS text FROM part""")
def metric_exponents(spark, sf_dir):
    """Exponents of quantities."""
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Area "), "p_size", F.lit(" m2 of"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("Flow "), "p_size", F.lit(" Nm3/h"))).otherwise("Code Xm3 is")
    return _table(spark, sf_dir, "part").select("p_partkey", "p_brand", T.metric_exponents(raw).alias("text"))


@_query("""WITH s AS (SELECT p_partkey, p_brand, CASE p_partkey % 5 WHEN 0 THEN p_name || p_type || p_type || p_name WHEN 1 THEN 'a/b' || p_partkey WHEN 2 THEN '''x' || p_partkey ELSE upper(p_name) END AS name FROM part)
SELECT p_partkey, CASE WHEN length(name) > 31 THEN 'too long' WHEN contains(name, '/') THEN 'forbidden character' WHEN starts_with(name, '''') THEN 'apostrophe at an edge' END AS error,
  count(*) OVER (PARTITION BY p_brand, lower(name)) > 1 AS taken FROM s""")
def sheet_names(spark, sf_dir):
    """valid and unique worksheet names."""
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat("p_name", "p_type", "p_type", "p_name")).when(k == 1, F.concat(F.lit("a/b"), "p_partkey")).when(k == 2, F.concat(F.lit("'x"), "p_partkey")).otherwise(F.upper("p_name"))
    s = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", name.alias("name"))
    same = F.count("*").over(Window.partitionBy("p_brand", F.lower("name"))) > 1
    return s.select("p_partkey", T.sheet_name_error(F.col("name")).alias("error"), same.alias("taken"))


@_query("""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN replace(text, chr(10), ' ') ELSE text END AS t FROM documents)
SELECT doc_id, regexp_extract_all(text, '[\\t\\n]') IS NOT DISTINCT FROM regexp_extract_all(t, '[\\t\\n]') AS kept FROM d""")
def boundary_check(spark, sf_dir):
    """F16, F19 over all rows: tabs and line ends kept in order, in documents with tabs too."""
    t = F.when(F.col("doc_id") % 4 == 0, F.replace("text", F.lit("\n"), F.lit(" "))).otherwise(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", T.boundaries(F.col("text")).eqNullSafe(T.boundaries(t)).alias("kept"))


@_query("""SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_discount > 0.05 THEN 'macro' END, CASE WHEN l_tax > 0.04 THEN 'formula-change' END, CASE WHEN l_returnflag = 'R' THEN 'chart' END, CASE WHEN l_quantity > 40 THEN 'comment' END], lambda x: x IS NOT NULL)::VARCHAR AS why,
  CASE WHEN l_discount > 0.05 OR l_tax > 0.04 THEN 'strict' WHEN l_returnflag = 'R' OR l_quantity > 40 THEN 'complex' ELSE 'fast' END AS mode FROM lineitem""")
def risk_reasons(spark, sf_dir):
    """Risk class and its reasons in order."""
    strict = snapshots.reasons([(F.col("l_discount") > 0.05, "macro"), (F.col("l_tax") > 0.04, "formula-change")])
    complex_ = snapshots.reasons([(F.col("l_returnflag") == "R", "chart"), (F.col("l_quantity") > 40, "comment")])
    mode = F.when(F.size(strict) > 0, "strict").when(F.size(complex_) > 0, "complex").otherwise("fast")
    why = F.concat(F.lit("["), F.array_join(F.concat(strict, complex_), ", "), F.lit("]"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", why.alias("why"), mode.alias("mode"))


@_query("""SELECT doc_id, rule FROM (SELECT doc_id, unnest([CASE WHEN n_chars <> length(text) THEN 'length' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' END, CASE WHEN n_chars > 5000 THEN 'size' END]) AS rule FROM documents) WHERE rule IS NOT NULL""")
def manifest_rules(spark, sf_dir):
    """V1, V2: all broken rules."""
    rules = {"length": F.col("n_chars") == F.length("text"), "language": F.col("lang").isin("en", "de", "fr"), "size": F.col("n_chars") <= 5000}
    return snapshots.check(_table(spark, sf_dir, "documents"), "doc_id", rules)


@_query("""SELECT source, arg_min(rule, doc_id * 10 + n) AS rule, (min(doc_id * 10 + n) // 10)::BIGINT AS doc_id FROM (
  SELECT doc_id, source, unnest([CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' END, CASE WHEN n_chars > 5000 THEN 'size' END]) AS rule, unnest([1, 2]) AS n FROM documents) WHERE rule IS NOT NULL GROUP BY source""")
def first_findings(spark, sf_dir):
    """The first broken rule of each job, in document order."""
    docs = _table(spark, sf_dir, "documents")
    found = snapshots.check(docs, "doc_id", {"language": F.col("lang").isin("en", "de", "fr"), "size": F.col("n_chars") <= 5000})
    return decisions.first_per_rule(found.join(docs.select("doc_id", "source"), "doc_id"), "source", ["doc_id", "rule"]).select("source", "rule", "doc_id")


@_query()
def relationship_closure(spark, sf_dir):
    """Parts that are reachable from a part; 3,483 links deep at sf0.1, too deep for SQL."""
    edges = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), (F.col("l_orderkey") + F.col("l_linenumber") * 7).alias("target"))
    return snapshots.closure(edges, spark.createDataFrame([(0,)], "owner bigint"))


@_query("""SELECT o_orderkey, n_name, coalesce(abs(o_totalprice - c_acctbal) <= 1270, false) AS near FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def host_geometry(spark, sf_dir):
    """Chained lookups and a tolerance."""
    o, c, n = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    near = F.coalesce(F.abs(F.col("o_totalprice") - F.col("c_acctbal")) <= 1270, F.lit(False))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("o_orderkey", "n_name", near.alias("near"))


@_query("""WITH c AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 1 THEN '  ' ELSE text END AS text FROM conversations), k AS (SELECT * FROM c WHERE trim(text) <> '')
SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS above FROM k""")
def text_above(spark, sf_dir):
    """The last non-blank text above in the same column."""
    c = _table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 1, "  ").otherwise(F.col("text")))
    return units.text_above(c, "conv_id", "role", "turn", "text").select("conv_id", "turn", "above")


@_query("""WITH c AS (SELECT l_orderkey, l_linenumber, count(*) FILTER (WHERE x <> '') AS n FROM (SELECT l_orderkey, l_linenumber, unnest([CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate::VARCHAR ELSE '' END, l_returnflag]) AS x FROM lineitem) GROUP BY ALL)
SELECT l_orderkey, min(l_linenumber) AS header_row FROM c WHERE n > 1 GROUP BY l_orderkey""")
def header_rows(spark, sf_dir):
    """The header row of each table."""
    texts = F.array(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate").cast("string")).otherwise(""), F.col("l_returnflag"))
    cells = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("row"), F.explode(texts).alias("text"))
    return grids.header_rows(cells, "l_orderkey")


@_query("""WITH b AS (SELECT s_suppkey AS id, s_nationkey AS image, (s_suppkey * 37 % 300)::DOUBLE AS x0, (s_suppkey * 37 % 300 + 120)::DOUBLE AS x1, (s_suppkey * 53 % 400)::DOUBLE AS y0 FROM supplier)
SELECT a.image, a.id, greatest(9.0, coalesce(min(abs(a.y0 - b.y0)), 60.0))::DOUBLE AS pitch FROM b a LEFT JOIN b ON a.image = b.image AND a.id <> b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 <> b.y0 AND abs(a.y0 - b.y0) <= 60 GROUP BY ALL""")
def label_pitch(spark, sf_dir):
    """Line pitch of labels in a picture."""
    k = F.col("s_suppkey")
    labels = _table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("image"), (k * 37 % 300).cast("double").alias("x0"), (k * 37 % 300 + 120).cast("double").alias("x1"), (k * 53 % 400).cast("double").alias("y0"))
    return grids.label_pitch(labels, "image").select("image", "id", "pitch")


@_query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE '=A' || (2 * n_nationkey - 1) || '+$B$' || (2 * 3 - 1) || '&"C9"' END AS mapped, 'rooms' AS sheet, n_nationkey AS r0 FROM nation WHERE n_nationkey > 0""")
def formula_rows(spark, sf_dir):
    """References, renames and row mapping of formulas."""
    k = F.col("n_nationkey").cast("string")
    formula = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("=OFFSET(A"), k, F.lit(",1,1)+Old!C"), k)).otherwise(F.concat(F.lit("=A"), k, F.lit('+$B$3&"C9"')))
    n = _table(spark, sf_dir, "nation").where("n_nationkey > 0").select("n_nationkey", formula.alias("f"))
    n = n.withColumn("refs", formulas.references_column(formulas.renamed_column(F.concat("f", F.lit("+Old!D"), k), {"Old": "rooms"}), F.lit("S")))
    last = F.element_at(F.filter("refs", lambda x: (x["kind"] == "range") & (x["sheet"] == "rooms")), -1)
    return n.select("n_nationkey", formulas.mapped_column(F.col("f")).alias("mapped"), last["sheet"].alias("sheet"), last["r0"].alias("r0"))


@_query()
def quality_errors(spark, sf_dir):
    """The first error of translations; equal rows are checked once."""
    none = F.lit(None).cast("string")
    p = _pairs(spark, sf_dir).select("source", "target").distinct()
    err = quality.error_column(F.col("source"), F.col("target"), F.lit("excel"), F.lit(None).cast("array<string>"), F.lit("de"), F.lit(False), none)
    return p.withColumn("error", err)


@_query("""SELECT p_partkey, (p_size * 3 = 4 * (p_partkey % 40)) AS exact_ratio,
  (('0x' || substr(md5(p_name), 5, 2))::INTEGER * 65536 + ('0x' || substr(md5(p_name), 3, 2))::INTEGER * 256 + ('0x' || substr(md5(p_name), 1, 2))::INTEGER)::INTEGER AS bgr FROM part""")
def ratio_math(spark, sf_dir):
    """Exact ratios by cross-multiplication; colours with blue first."""
    rgb = F.left(F.md5("p_name"), F.lit(6))
    return _table(spark, sf_dir, "part").select("p_partkey", T.same_ratio(F.col("p_size"), F.lit(4), F.col("p_partkey") % 40, F.lit(3)).alias("exact_ratio"), T.bgr(rgb).alias("bgr"))


@_query("""WITH i AS (SELECT s_suppkey AS id, md5(s_nationkey::VARCHAR) AS sha256, unnest([s_suppkey % 7, s_nationkey]) AS o, s_suppkey % 5 = 0 AS m FROM supplier)
SELECT min(id) AS id, sha256, array_to_string(list_sort(list(DISTINCT o)), ' ') AS occurrences, bool_or(m) AS manual_review, count(DISTINCT id) AS merged FROM i GROUP BY sha256""")
def merged_images(spark, sf_dir):
    """A3: equal pictures as one; a manual review sticks."""
    k = F.col("s_suppkey")
    images = _table(spark, sf_dir, "supplier").select(k.alias("id"), F.md5(F.col("s_nationkey").cast("string")).alias("sha256"), F.array(k % 7, F.col("s_nationkey").cast("bigint")).alias("occurrences"), F.when(k % 5 == 0, "manual_review").otherwise("open").alias("status"))
    return media.merge_images(images).withColumn("occurrences", F.array_join(F.col("occurrences").cast("array<string>"), " "))


@_query("""WITH s AS (SELECT DISTINCT l_partkey AS part, l_orderkey AS owner, CASE WHEN l_returnflag = 'R' THEN 'inline' ELSE 'anchor' END AS kind FROM lineitem WHERE l_linenumber <= 2)
SELECT p_partkey AS part, owner, kind FROM part LEFT JOIN s ON part = p_partkey""")
def media_hosts(spark, sf_dir):
    """The drawings that show each picture, and how."""
    items = _table(spark, sf_dir, "lineitem")
    relations = items.select(F.col("l_orderkey").alias("owner"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_returnflag").alias("rid"), F.col("l_partkey").alias("target"))
    anchors = items.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("owner"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_returnflag").alias("rid"), F.when(F.col("l_returnflag") == "R", "inline").otherwise("anchor").alias("kind"))
    return media.hosts(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")), relations, anchors.distinct())


_PLAN = "SELECT 'media/' || p_partkey % 1500 || '.png' AS part, 'new/' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '.PNG' ELSE '.jpg' END AS path, md5(p_name) AS sha256, p_size, p_type, p_name FROM part"


@_query(f"""WITH p AS ({_PLAN}), f AS (SELECT path, md5(CASE WHEN p_size % 7 = 0 THEN p_type ELSE p_name END) AS have FROM p WHERE p_size % 5 <> 0),
r AS (SELECT part, path, unnest([CASE WHEN have IS NULL THEN 'file missing' END, CASE WHEN have <> sha256 THEN 'digest differs' END, CASE WHEN path LIKE '%.jpg' THEN 'other suffix' END,
  CASE WHEN count(*) OVER (PARTITION BY part) > 1 THEN 'part claimed twice' END]) AS error FROM p LEFT JOIN f USING (path)) SELECT * FROM r WHERE error IS NOT NULL""")
def replacement_errors(spark, sf_dir):
    """Rules of a replacement plan."""
    _table(spark, sf_dir, "part").createOrReplaceTempView("_plan_part")
    plan = spark.sql(_PLAN.replace("FROM part", "FROM _plan_part"))
    files = plan.where("p_size % 5 <> 0").select("path", F.md5(F.when(F.col("p_size") % 7 == 0, F.col("p_type")).otherwise(F.col("p_name"))).alias("sha256"))
    return media.replacement_errors(plan.select("part", "path", "sha256"), files)


@_query("""SELECT c_custkey AS part, CASE WHEN c_custkey % 10 = 0 THEN 'part missing' WHEN c_custkey % 3 = 1 THEN 'still the source' ELSE 'unknown picture' END AS error FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 3 > 0""")
def pictures_not_replaced(spark, sf_dir):
    """Pictures that a package should have and hasn't."""
    k = F.col("c_custkey")
    c = _table(spark, sf_dir, "customer").select(k.alias("part"), F.md5("c_name").alias("source_sha256"), F.md5(F.concat("c_name", F.lit("new"))).alias("target_sha256"))
    part = F.col("part")
    output = c.where(part % 10 != 0).select("part", F.when(part % 3 == 0, F.col("target_sha256")).when(part % 3 == 1, F.col("source_sha256")).otherwise(F.md5(F.lit("x"))).alias("sha256"))
    return media.not_replaced(c, output)


@_query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN 'replace' END AS decision, CASE WHEN o_orderkey % 6 = 0 THEN 'overlay failed' END AS error FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 6 = 0""")
def pending_images(spark, sf_dir):
    """Undecided pictures and those that an error opens again."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return media.pending(o.withColumn("decision", F.when(F.col("id") % 4 > 0, "replace")), o.where("id % 6 = 0").withColumn("error", F.lit("overlay failed")))


@_query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'replace' WHEN 1 THEN 'retain' ELSE 'old' END AS decision, CASE o_orderkey % 3 WHEN 1 THEN o_orderpriority WHEN 2 THEN 'before' END AS reason,
  CASE o_orderkey % 3 WHEN 1 THEN 'no_text' WHEN 2 THEN 'logo_only' END AS reason_code FROM orders""")
def image_decisions(spark, sf_dir):
    """Decisions on pictures merged; a new one clears the old reason."""
    o, k = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    images = o.select(k.alias("id"), F.lit("old").alias("decision"), F.lit("before").alias("reason"), F.lit("logo_only").alias("reason_code"))
    said = o.where(k % 3 < 2).select(k.alias("id"), F.when(k % 3 == 0, "replace").otherwise("retain").alias("decision"), F.col("o_orderpriority").alias("reason"), F.lit("no_text").alias("reason_code"))
    return media.merge_decisions(images, said)


@_query("""WITH o AS (SELECT l_orderkey AS image, l_partkey AS id, CASE WHEN l_quantity = 7 THEN 'NaN'::DOUBLE ELSE l_quantity END AS x, l_linenumber * 10.0 AS y, l_quantity - 3 AS w FROM lineitem),
s AS (SELECT id FROM o GROUP BY id HAVING count(DISTINCT image) > 1),
r AS (SELECT image, o.id, unnest([CASE WHEN isnan(x) THEN 'not finite' WHEN w <= 0 THEN 'empty' WHEN x + w > 60 OR y + 5 > 60 THEN 'outside its host' WHEN y < 20 THEN 'above its label' END, CASE WHEN s.id IS NOT NULL THEN 'id in several pictures' END]) AS error FROM o LEFT JOIN s ON s.id = o.id)
SELECT * FROM r WHERE error IS NOT NULL""")
def overlay_errors(spark, sf_dir):
    """Geometry of overlays against their host, ids in one picture only."""
    q = F.col("l_quantity")
    rows = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), F.col("l_partkey").alias("id"), F.when(q == 7, float("nan")).otherwise(q).alias("x"), (F.col("l_linenumber") * 10.0).cast("double").alias("y"), (q - 3).alias("w"),
        F.lit(5.0).alias("h"), F.lit(60.0).alias("host_w"), F.lit(60.0).alias("host_h"), F.lit(20.0).alias("label_bottom"),
    )
    return media.overlay_errors(rows)


@_query("""WITH d AS (SELECT source, md5(concat_ws(chr(31), doc_id, coalesce(text, chr(0)))) AS m FROM documents),
s AS (SELECT source, count(*) AS units, sum(('0x' || substr(m, 1, 12))::BIGINT) AS a, sum(('0x' || substr(m, 13, 12))::BIGINT) AS b FROM d GROUP BY source)
SELECT source, units, md5(units || ':' || a || ':' || b) AS identity FROM s""")
def job_identities(spark, sf_dir):
    """A digest of each job's units, whatever their order."""
    return jobs.identities(_table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@_query("""SELECT p_partkey, sha256(to_json({'brand': p_brand, 'name': p_name, 'size': CASE WHEN p_size > 25 THEN p_size END})::VARCHAR) AS fingerprint FROM part""")
def unit_fingerprints(spark, sf_dir):
    """SHA-256 of JSON with sorted keys."""
    fields = {"size": F.when(F.col("p_size") > 25, F.col("p_size")), "name": F.col("p_name"), "brand": F.col("p_brand")}
    return _table(spark, sf_dir, "part").select("p_partkey", jobs.fingerprint(fields).alias("fingerprint"))


@_query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 9 = 0 OR o_orderstatus NOT IN ('F', 'O')""")
def foreign_rows(spark, sf_dir):
    """Worklist rows of another job, or of another state of it."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 9 == 0, "stale").otherwise(F.col("o_orderstatus")).alias("identity"))
    known = spark.createDataFrame([("F", "F"), ("O", "O")], "o_orderstatus string, identity string")
    return jobs.foreign(o, known, "o_orderstatus").select("o_orderkey", "o_orderstatus")


@_query("""SELECT c_custkey AS job, 'apply' AS stage, (c_custkey % 4 > 0 AND c_custkey % 5 > 0 AND c_custkey % 7 > 0) AS reuse FROM customer""")
def stage_reuse(spark, sf_dir):
    """Stages whose input and output are unchanged."""
    k = F.col("c_custkey")
    wanted = _table(spark, sf_dir, "customer").select(k.alias("job"), F.lit("apply").alias("stage"), F.md5("c_name").alias("input_key"))
    done = _table(spark, sf_dir, "customer").where(k % 4 > 0).select(k.alias("job"), F.lit("apply").alias("stage"), F.md5(F.when(k % 5 > 0, F.col("c_name")).otherwise("changed")).alias("input_key"), F.md5("c_mktsegment").alias("output_sha256"))
    outputs = _table(spark, sf_dir, "customer").select(k.alias("job"), F.lit("apply").alias("stage"), F.md5(F.when(k % 7 > 0, F.col("c_mktsegment")).otherwise("edited")).alias("sha256"))
    return jobs.reusable(done, wanted, outputs)


@_query("""SELECT c_custkey AS job, CASE WHEN c_custkey % 11 = 0 THEN 'failed' WHEN c_custkey % 3 = 0 THEN 'translate' WHEN c_custkey % 5 = 0 THEN 'images' WHEN c_custkey % 2 = 0 THEN 'delivered' ELSE 'ready' END AS status,
  (c_custkey % 2 = 0 AND (c_custkey % 3 = 0 OR c_custkey % 5 = 0)) AS deliver FROM customer""")
def job_status(spark, sf_dir):
    """What a job waits for, and whether it may be delivered."""
    k = F.col("c_custkey")
    c = _table(spark, sf_dir, "customer").select(k.alias("job"))
    j = F.col("job")
    state = jobs.status(c.select("job", (j % 3 == 0).cast("int").alias("pending"), (j % 5 == 0).cast("int").alias("images_pending"), (j % 11 == 0).alias("failed"), (j % 2 == 0).alias("delivered")))
    gate = jobs.deliverable(c.select("job", (j % 2 == 0).alias("rendered"), (j % 3 == 0).alias("reviewed"), (j % 5).alias("renderable")))
    return state.join(gate, "job")


@_query("""SELECT job, error FROM (SELECT c_custkey AS job, unnest([CASE WHEN c_custkey % 3 = 0 THEN 'digest' END, CASE WHEN c_custkey % 4 = 0 THEN 'language' END, CASE WHEN c_custkey % 5 = 0 THEN 'mode' END]) AS error FROM customer) WHERE error IS NOT NULL""")
def configuration_errors(spark, sf_dir):
    """Rules of a job's configuration."""
    k = F.col("c_custkey")
    c = _table(spark, sf_dir, "customer").select(k.alias("job"), F.when(k % 3 > 0, F.sha2("c_name", 256)).otherwise(F.md5("c_name")).alias("source_sha256"), F.when(k % 4 > 0, "de").otherwise("\u3000 ").alias("target_language"), F.when(k % 5 > 0, "bilingual").alias("output_mode"))
    return jobs.configuration_errors(c)


@_query("""SELECT l_orderkey AS key, l_returnflag AS error FROM lineitem EXCEPT SELECT o_orderkey * 2 - 1, o_orderstatus FROM orders EXCEPT SELECT l_orderkey * 2 - 1, l_returnflag FROM lineitem""")
def new_errors(spark, sf_dir):
    """Errors that the baseline doesn't have at the mapped row."""
    items, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    output = items.select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("error")).distinct()
    baseline = output.union(orders.select("o_orderkey", "o_orderstatus"))
    mapping = baseline.select("key").distinct().select("key", (F.col("key") * 2 - 1).alias("new_key"))
    return jobs.new_errors(output, baseline, mapping)


@_query("SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_quantity = 1 INTERSECT SELECT p_partkey FROM part WHERE p_size > 40")
def protected_removed(spark, sf_dir):
    """U4: protected parts that a removal would take."""
    removed = _table(spark, sf_dir, "lineitem").where("l_quantity = 1").select(F.col("l_partkey").alias("part"))
    return jobs.protected_removed(removed, _table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("part")))


@_query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC)::INTEGER AS step FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)")
def write_order(spark, sf_dir):
    """The last paragraph of a target is written first."""
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return jobs.write_order(items, "l_orderkey", "l_linenumber")


@_query("""WITH e AS (SELECT DISTINCT user_id, event_type FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS n FROM e)
SELECT user_id, string_agg(event_type, ', ' ORDER BY event_type) FILTER (WHERE n <= 3) AS message, greatest(0, count(*) - 3)::BIGINT AS rest FROM r GROUP BY user_id""")
def example_messages(spark, sf_dir):
    """The first examples in order, and how many more there are."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    return jobs.first_and_rest(e, "user_id", "event_type", 3).select("user_id", F.array_join("shown", ", ").alias("message"), F.col("rest").cast("bigint").alias("rest"))


@_query("""WITH f AS (SELECT l_orderkey AS id, bool_or(l_quantity > 45) AS f FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, CASE WHEN coalesce(f, false) THEN 'retain' ELSE o_orderstatus END AS status, CASE WHEN coalesce(f, false) THEN 'formula depends on the text' ELSE o_orderpriority END AS reason FROM orders LEFT JOIN f ON id = o_orderkey""")
def forced_retentions(spark, sf_dir):
    """Units that a formula depends on stay as they are."""
    u = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("reason"))
    return jobs.forced_retentions(u, _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit_id"), (F.col("l_quantity") > 45).alias("formula_dependency")))


@_query("""SELECT l_orderkey, l_linenumber, p_brand AS translation, CASE WHEN p_partkey IS NULL THEN 'unknown unit' WHEN l_linenumber = 3 THEN 'other source' END AS error FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 2""")
def unit_of(spark, sf_dir):
    """Occurrences with their unit's translation."""
    part = _table(spark, sf_dir, "part")
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 2).alias("unit_id"))
    rows = items.join(part.select(F.col("p_partkey").alias("unit_id"), "p_name"), "unit_id", "left").withColumn("source", F.when(F.col("l_linenumber") == 3, "another").otherwise(F.col("p_name")))
    known = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("source"), F.col("p_brand").alias("translation"))
    return jobs.unit_of(rows.drop("p_name"), known).select("l_orderkey", "l_linenumber", "translation", "error")


@_query("SELECT l_returnflag, l_linestatus, count(*) AS rows FROM lineitem GROUP BY ALL")
def histogram(spark, sf_dir):
    """How often each combination occurs."""
    return jobs.histogram(_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@_query("""WITH p AS (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' %1.%2' WHEN 1 THEN chr(8203) || chr(13) || chr(10) ELSE '' END AS t FROM part)
SELECT p_partkey, array_to_string(list_sort(regexp_extract_all(t, '%[0-9]')), ' ') AS placeholders, trim(replace(replace(t, chr(8203), ''), chr(13) || chr(10), '')) AS plain FROM p""")
def paragraph_texts(spark, sf_dir):
    """Numbering placeholders, width controls, line ends."""
    k = F.col("p_partkey") % 3
    p = _table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.when(k == 0, " %1.%2").when(k == 1, "\u200b\r\n").otherwise("")).alias("t"))
    return p.select("p_partkey", F.array_join(T.placeholders(F.col("t")), " ").alias("placeholders"), T.trim_ends(T.without_width_controls(F.col("t"))).alias("plain"))


@_query("""SELECT p_partkey, (p_partkey % 3 = 0 OR p_partkey % 3 = 2) AS human, (p_partkey % 4 < 2) AS external FROM part""")
def part_content(spark, sf_dir):
    """Parts with text for people, and with data from outside."""
    k = F.col("p_partkey")
    texts = F.when(k % 3 == 0, F.array(F.lit("12"), F.col("p_name"))).when(k % 3 == 1, F.array(F.lit("Click to add title"), F.lit("3.5 %"))).otherwise(F.array(F.lit("水")))
    part = F.when(k % 4 == 0, "xl/connections.xml").otherwise("xl/worksheets/sheet1.xml")
    formula = F.when(k % 4 == 1, "=[1]Old!A1+2").when(k % 4 == 2, "=SUM(A1:A3)")
    return _table(spark, sf_dir, "part").select("p_partkey", T.has_human_text(texts, F.array(F.lit("Click to add title"))).alias("human"), T.reads_external_data(part, formula).alias("external"))


@_query("""WITH d AS (SELECT o_custkey, list(DISTINCT o_orderkey % 9 ORDER BY o_orderkey % 9) AS l FROM orders GROUP BY 1)
SELECT o_custkey AS job, ['preflight', 'inspect', 'prepare', 'translate', 'validate', 'apply', 'verify', 'office-validate', 'deliver'][list_min(list_filter([0, 1, 2, 3, 4, 5, 6, 7, 8], lambda x: NOT list_contains(l, x))) + 1] AS next FROM d""")
def next_stage(spark, sf_dir):
    """The first stage that a job hasn't done."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.get(F.array(*map(F.lit, fixed.STAGES)), (F.col("o_orderkey") % 9).cast("int")).alias("stage"))
    return jobs.next_stage(o)
