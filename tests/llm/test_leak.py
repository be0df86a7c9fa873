from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import leak as L

ITEM = "Ships bound for Casersimar waited 8484 hours off Fenaval because Draamar lacked good pilots in the long winter."


def test_words():
    text = "STRASSE Straße \u00e9t\u00e9 e\u0301te\u0301 \ufb02ow \uff11\uff12 co\u00adop zero\u200bwidth"
    assert L.words_of(text) == ["strasse", "strasse", "ete", "ete", "flow", "12", "coop", "zerowidth"]
    assert L.words_of("bef-\nörderte (Hear, (hear) all) so [Applause] it") == ["beforderte", "so", "it"]
    assert L.words_of(None) == L.words_of("") == L.words_of("(only this)") == []


def test_documents(spark):
    words = ITEM.split()
    texts = [ITEM, "x " + " ".join(words[3:15]).upper() + " y", " ".join(words[3:14]) + " y", "so: " + " ".join(words[:6]) + " (Interruption.) — " + " ".join(words[6:12]), None, "", "a " * 50_000 + ITEM, ITEM]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS Item_ID")
    items = spark.createDataFrame([(7, ITEM), (8, "too short"), (9, ITEM + " And more."), (10, None)], "item_id long, text string")
    got = {(r[0], r[1]) for r in L.leaked_items(docs, items).collect()}
    assert got == {(d, i) for d in (0, 1, 3, 6, 7) for i in (7, 9)}
    assert L.leaked_items(docs.limit(0), items).count() == 0 and L.leaked_items(docs, items.limit(0)).count() == 0


def test_passes(spark, monkeypatch):
    monkeypatch.setattr(L, "PASS_CHARS", 100)
    items = spark.createDataFrame([(i, ITEM.replace("good", f"good{i}")) for i in range(9)], "item_id int, text string")
    docs = spark.createDataFrame([(str(i), ITEM.replace("good", f"good{i}")) for i in range(9)], "doc_id string, text string")
    assert {(r[0], r[1]) for r in L.leaked_items(docs, items, words=16).collect()} == {(str(i), i) for i in range(9)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=30), max_size=4), st.lists(st.sampled_from("abcd"), max_size=80), st.integers(2, 6))
def test_search_equals_brute_force(items, text, m):
    named = dict(enumerate(items))
    windows = {tuple(text[i : i + m]) for i in range(len(text) - m + 1)}
    want = {n for n, w in named.items() if any(tuple(w[i : i + m]) in windows for i in range(len(w) - m + 1))}
    assert L.Patterns.of(named, m).found_in(text) == want


def test_long_and_deep_interjections():
    words = ITEM.split()
    for aside in ("(" + "very long " * 90 + ")", "((((((deep))))))", "[(a) [b] (c [d])]", "(a) [b]"):
        assert L.words_of(" ".join(words[:6]) + f" {aside} " + " ".join(words[6:])) == L.words_of(ITEM)
    assert L.words_of("a) b (c d [e) f] (g) h") == list("abcdefh")
    assert L.words_of("(a [b] c") == list("ac") and L.words_of("(" * 50_000 + "a") == ["a"]


def test_stray_brackets_hide_nothing(spark):
    words = ITEM.split()
    texts = ["x " + "(y " * 3 + "z " * 300 + ITEM + " z)", " ".join(words[:6]) + " (" + "very long " * 90 + ") " + " ".join(words[6:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert {r[0] for r in L.leaked_items(docs, items).collect()} == {0, 1}
