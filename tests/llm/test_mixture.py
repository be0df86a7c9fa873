import pytest
from pyspark.sql import functions as F

from trackloom.llm import mixture as M


def docs(spark, n=300):
    rows = [(i, "a" if i % 3 else "b", "word " * (5 + i % 7)) for i in range(n)] + [(n, "c", None), (n + 1, "c", ""), (n + 2, None, "some words")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("Tokens", F.lit(1)).drop("Tokens")


def test_tokens(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("",), ("<|endoftext|>",)], "text string")
    got = [r["n"] for r in df.select(M.token_count(F.col("text")).alias("n")).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 1


def test_mixture(spark):
    d = docs(spark)
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.6, 2), ("missing", 0.1, 5)], "source string, target_share double, max_repeats int")
    sizes = {r["source"]: r["size"] for r in M.source_sizes(d.select("source", M.token_count(F.col("text")).alias("tokens"))).collect()}
    total = sum(sizes.values())
    want = {s for s, share, most in [("a", 0.3, 1), ("b", 0.6, 2), ("missing", 0.1, 5)] if share * total > most * sizes.get(s, 0)}
    assert {r[0] for r in M.unreachable_sources(d, targets).collect()} == want and "missing" in want
    chosen = M.mixture(d, targets, schedules={"a": [(0.0, 0.0), (1.0, 2.0)]}).cache()
    rows = sorted(chosen.collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(len(rows))) and [r["time"] for r in rows] == sorted(r["time"] for r in rows)
    tokens = {s: sum(r["tokens"] for r in rows if r["source"] == s) for s in ("a", "b")}
    longest = max(r["tokens"] for r in rows)
    assert 0 <= tokens["a"] - 0.3 * total < longest and 0 <= tokens["b"] - min(0.6 * total, 2 * sizes["b"]) < longest
    assert max(r["repeat"] for r in rows) <= 1 and len({(r["doc_id"], r["repeat"]) for r in rows}) == len(rows)
    early = [r for r in rows if r["source"] == "a" and r["time"] < 0.5]
    assert sum(r["tokens"] for r in early) == pytest.approx(0.25 * tokens["a"], abs=longest)  # integral of 2t up to a half
    shares = {r["source"]: r for r in M.reached_shares(chosen, targets).collect()}
    assert shares["missing"]["tokens"] == 0 and sum(r["actual_share"] for r in shares.values()) == pytest.approx(1)
    assert M.mixture(d.limit(0), targets).count() == 0


def test_tokenizer_files_agree(spark):
    texts = [("The Minister's 12.5 % — ¿qué?  \n\n Straße",), ("a" * 5000,), (" " * 200_000,), ("x" * 200_000,)]
    df = spark.createDataFrame(texts, "text string")
    a, b = (sorted(r[0] for r in df.select(M.token_count(F.col("text"), f"/opt/tokenizers/byte_bpe_50k.{e}")).collect()) for e in ("tiktoken", "json"))
    assert a == b


@pytest.mark.parametrize("schedule", [M.EVEN, [(0.0, 0.0), (0.2, 0.0), (1.0, 2.0)], [(0.0, 3.0), (0.5, 0.0), (0.75, 0.0), (1.0, 1.0)], [(0.0, 1.0), (0.3, 4.0), (1.0, 0.0)]])
def test_inversion_is_exact(spark, schedule):
    """Integrating the schedule to the inverted time gives the demand again."""
    segments = M.schedule_segments(schedule)
    targets = M.with_schedules(spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"), {"a": schedule})
    shares = spark.range(0, 1001).selectExpr("id / 1000.0D AS share").crossJoin(targets.select("segments"))
    for r in shares.select("share", M.wanted_time(F.col("share"), F.col("segments")).alias("t")).collect():
        start, before, weight, slope = [s for s in segments if s[0] <= r["t"]][-1]
        x = r["t"] - start
        assert before + weight * x + slope * x * x / 2 == pytest.approx(r["share"], abs=1e-9) and 0 <= r["t"] <= 1 + 1e-12


def test_schedules_change_positions(spark, monkeypatch):
    d = docs(spark)
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("missing", 0.1, 5)], "source string, target_share double, max_repeats int")
    late = {"a": [(0.0, 0.0), (0.5, 0.0), (1.0, 1.0)]}
    even, bent = ({(r["doc_id"], r["repeat"]): r["position"] for r in M.mixture(d, targets, schedules=s).collect()} for s in (None, late))
    assert even.keys() == bent.keys() and even != bent  # the same copies in another order
    plan = {r["source"]: r["exhausted_at"] for r in M.plan_shares(spark.createDataFrame([("a", 100), ("b", 10)], "source string, size long"), targets, {"b": [(0.0, 1.0), (1.0, 1.0)]}).collect()}
    assert plan["a"] is None and plan["b"] == pytest.approx(20 / 33) and plan["missing"] == 0
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)  # the way beyond it gives the same
    assert {(r["doc_id"], r["repeat"]): r["position"] for r in M.mixture(d, targets, schedules=late).collect()} == bent


@pytest.mark.parametrize("bad", [[], [(0.0, 1.0)], [(0.0, 1.0), (0.5, 1.0)], [(0.0, -1.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 0.0)], [(0.0, 1.0), (0.0, 1.0), (1.0, 1.0)]])
def test_schedules_are_checked(bad):
    with pytest.raises(ValueError):
        M.schedule_segments(bad)
