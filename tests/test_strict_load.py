from pyspark.sql import functions as F

from trackloom.operators import strict_load as S

GOOD = ["a1", "T", "A", "g", "", "0", "1", "0.5", "300", "-60", "0", "0", "0", "0", "1", "11", "0", "7", "100"]


def line(**changes):
    fields = dict(zip(S.RECORD_FIELDS, GOOD)) | changes
    return ",".join(fields.values())


def reasons(spark, lines):
    raw = spark.createDataFrame(list(enumerate(lines)), "line_id long, raw_line string").withColumn("ID", F.lit("clash"))
    out = {}
    for r in S.failure_reasons(raw).collect():
        out.setdefault(r["line_id"], set()).add(r["reason"])
    loaded = {r["line_id"] for r in S.strict_load(raw).collect()}
    assert loaded == set(range(len(lines))) - set(out)
    return [out.get(i, set()) for i in range(len(lines))]


def test_reasons(spark):
    cases = [
        (line(), set()), (None, {"column_count"}), ("", {"column_count"}), (",", {"column_count"}), (line() + ",", {"column_count"}),
        (line(title='"a, ""b"" \n c"'), set()), (line(title='a "b"'), {"quoting"}), (line(title='"a"b'), {"quoting"}), (line(title='"open'), {"quoting"}),
        (line(title='""'), {"title"}), (line(artist="  \t"), {"artist"}), (line(valence="1.8", mode="7", title=" "), {"title", "valence", "mode"}),
        (line(tempo="0"), {"tempo"}), (line(tempo="300.1"), {"tempo"}), (line(key="3.7"), set()), (line(key="-0.9"), set()), (line(key="12"), {"key"}),
        (line(energy="0.5f"), {"energy"}), (line(energy="nan"), {"energy"}), (line(energy=" +.5e0 "), set()), (line(duration_ms="2.15e5"), set()),
        (line(duration_ms="0x10"), {"duration_ms"}), (line(duration_ms="inf"), {"duration_ms"}), (line(loudness="−7"), {"loudness"}), (line(duration_ms="9999999999"), set()),
        (line(popularity="100.9"), set()), (line(popularity="101"), {"popularity"}), (line(genre="polka"), set()), (line(title='"' + "x" * 300_000 + '"'), set()),
        (line(title="y" * 300_000 + '"'), {"quoting"}), (line(), set()), ("," * 200_000, {"column_count"}),
    ]
    assert reasons(spark, [c[0] for c in cases]) == [c[1] for c in cases]


def test_empty_and_rejected_rows(spark):
    empty = spark.createDataFrame([], "line_id long, raw_line string")
    assert S.failure_reasons(empty).count() == 0 and S.strict_load(empty).count() == 0
    raw = spark.createDataFrame([(1, line(tempo="0", key="x")), (2, "a,b")], "line_id long, raw_line string")
    rows = {r["line_id"]: r for r in S.rejected_rows(raw).collect()}
    assert rows[1]["errors"] == "tempo=0.0 out of range (0,300]; key is not numeric: 'x'" and '"tempo":"0"' in rows[1]["raw_json"]
    assert rows[2]["errors"] == "column_count" and '"line":"a,b"' in rows[2]["raw_json"]


def test_typed_values(spark):
    raw = spark.createDataFrame([(1, line(key="3.7", duration_ms="2.15e5", title='" a ""q"""'))], "line_id long, raw_line string")
    row = S.strict_load(raw).first()
    assert (row["key"], row["duration_ms"], row["title"], row["tempo"]) == (3, 215000, 'a "q"', 300.0)


def test_quarantine_wording(spark):
    from trackloom.operators import strict_load as S
    from trackloom.schema import RECORD_FIELDS

    good = dict(zip(RECORD_FIELDS, ["a", "T", "A", "g", "", "0", "1", "0.5", "300", "-60", "0", "0", "0", "0", "1", "11", "0", "7", "100"]))
    line = lambda **k: ",".join((good | k).values())
    lines = [line(), line(title=" ", valence="1.8", mode="7"), 'x"y,' + line(), "a,b", None, line(tempo="fast")]
    raw = spark.createDataFrame(list(enumerate(lines)), "line_id long, raw_line string")
    got = {r["line_id"]: (r["errors"], r["raw_json"]) for r in S.rejected_rows(raw).collect()}
    assert got[1][0] == "title is missing/empty; valence=1.8 out of range [0,1]; mode=7 must be 0 or 1" and '"title":" "' in got[1][1]
    assert got[2][0] == "quoting" and got[3][0] == got[4][0] == "column_count" and got[5][0] == "tempo is not numeric: 'fast'" and 0 not in got
    reasons = {}
    for r in S.failure_reasons(raw).collect():
        reasons.setdefault(r["line_id"], set()).add(r["reason"])
    assert reasons.keys() == got.keys() and reasons[1] == {"title", "valence", "mode"}
