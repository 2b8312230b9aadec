from glotmill.operators import formulas as X


def spans(f):
    return [(r["sheet"], r["c0"], r["r0"], r["c1"], r["r1"]) for r in X.references(f, "S") if r["kind"] == "range"]


def test_references():
    assert spans("=A1+$B$2:C4") == [("S", 1, 1, 1, 1), ("S", 2, 2, 3, 4)]
    assert spans("='My Sheet'!A1+Other!B:C+3:4") == [("My Sheet", 1, 1, 1, 1), ("Other", 2, 1, 3, X.MAX_ROW), ("S", 1, 3, X.MAX_COL, 4)]
    assert spans('=INDIRECT("D5")') == [("S", 4, 5, 4, 5)]
    assert [r["kind"] for r in X.references('=OFFSET(A1,1,1)&"text ""x"""', "S")] == ["unresolved", "range", "literal"]
    assert [r["kind"] for r in X.references("=[1]Book!A1", "S")] == ["external"]
    assert spans("=LOG10(A2)") == [("S", 1, 2, 1, 2)]
    assert X.references(None, "S") == []


def test_rename_is_simultaneous():
    assert X.rename('=A!B1+B!A1&"A!B1"', {"A": "B", "B": "A b"}) == "='B'!B1+'A b'!A1&\"A!B1\""
    assert X.rename("=[1]A!B1", {"A": "Z"}) == "=[1]A!B1"


def test_map_rows_and_shift():
    assert X.map_rows('=A2+$B$3:C4&"A9"') == '=A3+$B$5:C7&"A9"'
    assert X.map_rows("=ROW(A1)") is None
    for f in ("=VLOOKUP(A5,B2:C9,2,0)", "=sumifs(A:A,B:B,1)", "=COUNTA(A1:A3)", "=[1]A!B1", "=A600000", "=_xlfn.XLOOKUP(A1,B1,C1)"):
        assert X.map_rows(f) is None, f
    assert X.map_rows('="ROW("&A3') == '="ROW("&A5' and X.map_rows("=THROW(A1)+Row!A2") == "=THROW(A1)+Row!A3"
    assert X.rename("=Old!A1+Old!B2", {"Old": "TRUE"}) == "='TRUE'!A1+'TRUE'!B2" and X.rename("=Old!A1", {"Old": "R1C1"}) == "='R1C1'!A1"
    assert X.shift("=A1+$B$2+C$3", 1, 2) == "=B3+$B$2+D$3"


def test_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("=A2", "S"), (None, "S")], "f string, s string")
    got = df.select(X.mapped_column(F.col("f")).alias("m"), F.size(X.references_column(F.col("f"), F.col("s"))).alias("n")).collect()
    assert [(r.m, r.n) for r in got] == [("=A3", 1), (None, 0)]
