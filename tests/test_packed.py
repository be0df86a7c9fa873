from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.operators import packed as P

TAGS = ["happy", "sad", "lo-fi", "don't stop", "warm & fuzzy", "old, but gold", "call|answer", "stop/start", "80's glow"]


def book():
    return P.CodeBook.of({t: 1000 for t in TAGS}, 1000 * len(TAGS))


def cut(text):
    return P.cheapest(text, book())


def test_dialects():
    assert cut("happy|sad|happy") == ["happy", "sad", "happy"]
    assert cut(' happy ; "old, but gold";;sad; ') == ["happy", "old, but gold", "sad"]
    assert cut('["happy", "call|answer"]') == ["happy", "call|answer"]
    assert cut("{sad,lo-fi}") == ["sad", "lo-fi"]
    assert cut("'stop/start' • don't stop") == ["stop/start", "don't stop"]
    assert cut("80's glow/sad , happy;;lo-fi") == ["80's glow", "sad", "happy", "lo-fi"]
    assert cut("sad\thappy\nlo-fi") == ["sad", "happy", "lo-fi"]
    assert cut("HAPPY|Warm & fuzzy") == ["HAPPY", "Warm & fuzzy"]
    assert cut(" , ") == cut("|") == cut("") == cut('""|" "') == []
    assert cut("'happy") == ["'happy"] and cut("new tag/other one") == ["new tag", "other one"]
    assert cut("happy" + "|sad" * 20_000) == ["happy"] + ["sad"] * 20_000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(TAGS), min_size=1, max_size=5), st.sampled_from(["|", ",", ";", "/", " + ", "\t", "、", ";;"]), st.sampled_from(['"', "'"]))
def test_round_trip(tags, delimiter, mark):
    """Values are enclosed where they hold something that delimits; then they come back."""
    written = [f"{mark}{t}{mark}" if any(P.splits(c) for c in t) else t for t in tags]
    assert cut(delimiter.join(written)) == tags


def test_table(spark):
    rows = [(i, t) for i, t in enumerate(["happy|sad", "happy|sad", None, "", "sad,happy", '"a, b"|sad'] + ["sad|happy"] * 50)]
    df = spark.createDataFrame(rows, "row_num long, mood_tags string").withColumnRenamed("row_num", "row_num")
    df = df.selectExpr("*", "'x' AS Tag")
    out = {(r["row_num"], r["tag_pos"]): r["tag"] for r in P.unpack(df, "mood_tags", ["row_num"]).collect()}
    assert (out[0, 1], out[0, 2], out[1, 1], out[4, 2], out[5, 1], out[5, 2]) == ("happy", "sad", "happy", "happy", "a, b", "sad")
    assert not any(k in out for k in [(2, 1), (3, 1)]) and len(out) == 8 + 100
    assert P.unpack(df.limit(0), "mood_tags", ["row_num"]).count() == 0


def test_sample_table_matches_plain_reading(spark, small):
    """In the sample tables tags hold delimiters inside quote marks only, so a plain reading is right there too."""
    import re

    from trackloom.session import read_table

    df = read_table(spark, small, "tracks").select("row_num", "mood_tags")
    got = {}
    for r in P.unpack(df, "mood_tags", ["row_num"]).collect():
        got.setdefault(r["row_num"], []).append((r["tag_pos"], r["tag"]))
    pattern = re.compile(r"""\s*(?:"([^"]*)"|'([^|,;/+\t\n•、；·]*(?:[|,;/+][^'|]*)?)'|([^|,;/+\t\n•、；·]*))\s*(?:[|,;/+\t\n•、；·]|$)""")
    for r in df.collect():
        text = (r["mood_tags"] or "").strip()
        if len(text) > 1 and text[0] + text[-1] in ("[]", "{}"):
            text = text[1:-1]
        want = [next(g for g in m.groups() if g is not None).strip() for m in pattern.finditer(text) if m[0]]
        assert [t for _, t in sorted(got.get(r["row_num"], []))] == [w for w in want if w], text


def test_six_delimiters_are_all_weighed(spark):
    """More than five delimiters in one field: every combination of them is a dialect."""
    text = "a|b;c,d/e:f~g"
    sets = {d for _, d, _, _ in P.dialects(text)}
    marks = {c for c in text if P.splits(c)}
    assert len(marks) > 5 and len(sets) == 2 ** len(marks)
