import os
import random

import pytest
from pyspark.sql import functions as F

from glotmill.functions import text as T
from glotmill.operators import batches, decisions, glossary, grids, snapshots
from glotmill.streaming.merging import merge_stream


def test_greedy_and_elision(spark):
    rows = [("j", i, n) for i, n in enumerate((5, 6, 20, 1, 9, 2))]
    df = spark.createDataFrame(rows, "job string, ord int, cost int")
    got = [(r.ord, r.batch_index) for r in batches.greedy_batches(df, ["job"], "ord", "cost", 11).orderBy("ord").collect()]
    assert got == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 3), (5, 4)]
    units = spark.createDataFrame([("j", 1, 0, "p", "ab", "", "cd"), ("j", 1, 1, "p", "cdx", "b", ""), ("j", 2, 2, "p", "z", "x", "")], "job string, batch_index int, ord int, part string, source string, before string, after string")
    got = [(r.before, r.after, r.saved) for r in batches.elide_context(units, ["job"], "ord").orderBy("ord").collect()]
    assert got == [("", "", 2), ("", "", 1), ("x", "", 0)]


def test_merge_is_idempotent_and_streams(spark, tmp_path):
    units = spark.createDataFrame([("a", "A", "", "pending"), ("b", "B", "", "pending")], "unit_id string, source string, translation string, status string")
    made = [("a", "A", "x", "translated"), ("b", "?", "y", "translated"), ("c", "C", "z", "translated"), ("b", "B", " ", "pending")]
    made = spark.createDataFrame(made, units.schema)
    once = decisions.merge(units, decisions.judge(made, units))
    twice = decisions.merge(once, decisions.judge(made, once))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", "A", "x", "translated"), ("b", "B", "", "pending")]
    units.write.parquet(f"{tmp_path}/units/v=0")
    made.write.parquet(f"{tmp_path}/in")
    q = merge_stream(spark.readStream.schema(units.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/units", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/units/v=1").collect())) == sorted(map(tuple, once.collect()))


def test_invalidate(spark):
    df = spark.createDataFrame([("j", "inspect"), ("j", "apply"), ("j", "deliver")], "job string, stage string")
    assert [r.stage for r in decisions.invalidate(df, "job", "stage", F.lit("apply")).collect()] == ["inspect"]


def test_glossary(spark):
    lines = ["| 中文 | English |", "|---|---|", '| 水泵 | pump <!-- {"aliases": ["water pump"], "context": "c"} --> |', "| 水泵 | pump |", "| 阀 | valve | x |", "text"]
    df = spark.createDataFrame([*enumerate(lines)], "n int, value string")
    entries = glossary.parse_markdown(df)
    assert {(r.source, r.target) for r in entries.collect()} == {("水泵", "pump"), ("阀", "valve")}
    back = glossary.reverse(entries)
    assert {(r.source, r.target) for r in back.collect()} == {("pump", "水泵"), ("water pump", "水泵"), ("valve", "阀")}
    texts = spark.createDataFrame([(1, "The water pump."), (2, " Valve "), (3, "项目总计金额"), (4, "the main power supply, pumped"), (5, None), (6, "计"), (7, "Ünit a.b+c x")], "k int, t string")
    more = back.select("source", "target").union(spark.createDataFrame([("总计", "Total"), ("main power supply", "x"), ("power", "y"), ("计", "z"), ("a.b+c", "w"), ("ünit", "v")], "source string, target string"))
    got = {(r.k, r.source, r.match_type) for r in glossary.word_matches(texts, more, "k", "t").collect()}
    assert got == {
        (1, "pump", "contained"), (1, "water pump", "contained"), (2, "valve", "exact"), (3, "总计", "contained"), (3, "计", "contained"),
        (4, "main power supply", "contained"), (4, "power", "contained"), (6, "计", "exact"), (7, "a.b+c", "contained"), (7, "ünit", "contained"),
    }
    found = texts.select(glossary.longest_terms(F.col("t"), ["pump", "water pump", "val", "总", "总计"])).collect()
    assert [[(x.start, x.term) for x in r[0]] for r in found][:5] == [[(4, "water pump")], [], [(2, "总计")], [], []]


def test_texts(spark):
    df = spark.createDataFrame([("　a  ",), ("Power: 45 kW",), ("状态: 好",), ("m3 5m3 am3",), ("3 x 4 mm",), ("A1",)], "s string")
    got = df.select(T.strip(F.col("s")).alias("s"), T.parameter(F.col("s"))["label"].alias("p"), T.metric_exponents(F.col("s")).alias("m"), T.is_safe_dimension(F.col("s")).alias("d")).collect()
    assert [r.s for r in got][0] == "a" and [r.p for r in got] == [None, "Power", None, None, None, None]
    assert got[3].m == "m3 5m³ am3" and [r.d for r in got].count(True) == 1
    pats = spark.createDataFrame([("a*c", "abbc"), ("a~*c", "abbc"), ("a~*c", "a*c"), ("a?c.", "abcx"), ("a?c.", "abc.")], "w string, t string")
    assert [r[0] for r in pats.select(F.regexp_like("t", T.wildcard_pattern(F.col("w")))).collect()] == [True, False, True, False, True]


def test_snapshots_and_grids(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "z")], "k int, v string")
    assert {(r.k, r.change) for r in snapshots.diff(a, b, ["k"], "v").collect()} == {(1, "same"), (2, "same"), (3, "removed"), (4, "added")}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "owner string, target string")
    assert {r.node for r in snapshots.closure(edges, spark.createDataFrame([("a",)], "owner string")).collect()} == {"a", "b", "c"}
    cells = spark.createDataFrame([("S", 1, 1), ("S", 3, 1)], "sheet string, col int, row int")
    merges = spark.createDataFrame([("S", 1, 1, 2, 1)], "sheet string, c0 int, r0 int, c1 int, r1 int")
    widths = spark.createDataFrame([("S", 1, 10.0), ("S", 2, 5.0)], "sheet string, col int, width double")
    assert {(r.col, r.width) for r in grids.merged_width(cells, merges, widths).collect()} == {(1, 15.0), (3, 8.43)}


def test_deep_closure(spark):
    pairs = [(i, i + 1) for i in range(400)] + [(400, 3), (1000, 1001), (7, 900), (900, 5)]
    edges = spark.createDataFrame(pairs, "owner bigint, target bigint")
    for block in (50, 100_000):
        got = [r.node for r in snapshots.closure(edges, spark.createDataFrame([(0,)], "owner bigint"), block).collect()]
        assert sorted(got) == [*range(401), 900]


def test_closure_takes_few_rounds(spark, monkeypatch):
    from glotmill.plans import storage

    kept, times = storage.settled, []
    monkeypatch.setattr(storage, "settled", lambda df: times.append(1) or kept(df))
    rng = random.Random(4)
    chain = [(i, i + d) for i in range(3000) for d in (1, 3)] + [(2990, 20), (7000, 7001), (None, 5000), (17, None)]
    loose = [(rng.randrange(400), rng.randrange(400)) for _ in range(420)]  # shortening leaves too many edges here
    for pairs, block in ((chain, 200), (loose, 60)):
        targets = {}
        for a, b in pairs:
            targets.setdefault(a, []).append(b)
        seen, todo = {0, 9999}, [0, 9999]
        while todo:
            for t in targets.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo += [t] if t is not None else []
        edges = spark.createDataFrame(pairs, "owner bigint, target bigint")
        got = [r.node for r in snapshots.closure(edges, spark.createDataFrame([(0,), (9999,)], "owner bigint"), block).collect()]
        assert sorted(got, key=repr) == sorted(seen, key=repr)
        assert pairs is loose or len(times) < 25, len(times)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_closure_of_all_rows(spark):
    from glotmill import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber").collect()
    targets = {}
    for a, n in rows:
        targets.setdefault(a, set()).add(a + n * 7)
    seen, todo = {0}, [0]
    while todo:
        for t in targets.get(todo.pop(), ()):
            if t not in seen:
                seen.add(t)
                todo.append(t)
    got = [r.node for r in queries.QUERIES["relationship_closure"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(seen)


def slow_lines(text, cap=34):
    """Display lines of a cell, word by word."""
    size = lambda s: sum(1 if ord(c) < 128 else 2 for c in s)
    total = 0
    for line in text.replace("\r\n", "\n").split("\n"):
        words = line.split()
        if len(words) <= 1:
            total += max(1, -(-size(line) // cap))
            continue
        lines, used = 1, 0
        for n in map(size, words):
            if used and used + 1 + n <= cap:
                used += 1 + n
                continue
            lines += max(1 if used else 0, -(-n // cap) - (0 if used else 1))
            used = n % cap or min(n, cap)
        total += lines
    return total


def test_heights_and_boundaries_of_all_rows(spark, tmp_path):
    from glotmill import queries

    made = ["", None, "one", "a line\nand a second one that is far too long for a column of width thirty", "\n\n", "x" * 80 + " y\r\nüü " + "z" * 40, "tab\there\nand there"]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(made)], "conv_id bigint, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate([*made, "\t", "a\n\tb"])], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.conv_id: (r.lines, r.height) for r in queries.QUERIES["row_heights"](spark, str(tmp_path)).collect()}
    assert got == {i: (n, min(409.5, n * 15.0 + 3)) for i, n in enumerate(slow_lines(t or "") for t in made)}
    kept = {r.doc_id: r.kept for r in queries.QUERIES["boundary_check"](spark, str(tmp_path)).collect()}
    assert kept == {i: not (i % 4 == 0 and "\n" in (t or "")) for i, t in enumerate([*made, "\t", "a\n\tb"])}


def test_short_and_unspaced_passages(spark):
    import random

    rng = random.Random(4)
    made = ["".join(rng.choices("ab 日本語é😀\n", k=rng.randint(0, 60))) for _ in range(60)] + [None, "", "one two three four five six seven eight"]
    passages = [t[i : i + n] for t in made[:20] for n in (1, 2, 3, 5, 9, 16, 17, 30) for i in (0, 7) if t[i : i + n]]
    passages += ["", None, "two three", "wo three f", "one two three four five six seven", "not there", "日本語日本語日本語日本語日本語日本語", "二"]
    texts = spark.createDataFrame(list(enumerate(made)), "k int, t string")
    items = spark.createDataFrame(list(enumerate(passages)), "i int, p string")
    got = sorted(map(tuple, glossary.contained(texts, items, "k", "t", "i", "p").collect()))
    assert got == sorted((k, i, t.index(p) + 1) for k, t in enumerate(made) for i, p in enumerate(passages) if t is not None and p is not None and p in t)


def test_metric_exponents_leave_codes(spark):
    cases = [
        ("X30m3", "X30m3"), ("AB12cm2", "AB12cm2"), ("30m3-A", "30m3-A"), ("MODEL/Nm3", "MODEL/Nm3"), ("Storage: 30m3", "Storage: 30m³"), ("Density: 1.45t/m3", "Density: 1.45t/m³"),
        ("Area: 3500cm2/g", "Area: 3500cm²/g"), ("Dust: 20mg/Nm3", "Dust: 20mg/Nm³"), ("Flow: 30 m3/h", "Flow: 30 m³/h"), ("RM-30m3", "RM-30m3"), ("MODEL/30m3", "MODEL/30m3"),
        ("Range: 30-40m3/h", "Range: 30-40m³/h"), ("30m3 3500cm2/g 20mg/Nm3 ModelM3 m300", "30m³ 3500cm²/g 20mg/Nm³ ModelM3 m300"), ("see m3 here", "see m3 here"),
    ]
    got = spark.createDataFrame(cases, "s string, want string").select("want", T.metric_exponents(F.col("s")).alias("got")).collect()
    assert [r for r in got if r.got != r.want] == []


def test_wrapped_lines_of_spaces(spark):
    cases = [(" " * 100, 1), ("", 1), ("x" * 50, 3), ("  " + "x" * 10 + " " * 60, 1), ("a\n \nb", 3), ("x" * 23 + " y", 2)]
    got = spark.createDataFrame(cases, "s string, want int").select("want", T.wrapped_lines(F.col("s"), F.lit(20.0)).alias("got")).collect()
    assert [r for r in got if r.got != r.want] == []
