import math
import random

import pyarrow as pa
import pyarrow.parquet as pq

from trackloom.operators import profile as P
from trackloom.sources.footers import chunk_facts


def write(path, rows, group=50, **options):
    schema = pa.schema([("load_id", pa.int32()), ("loudness", pa.float64()), ("popularity", pa.int32()), ("genre", pa.string()), ("finding", pa.string())])
    pq.write_table(pa.Table.from_pylist([r | {"finding": "clash"} for r in rows], schema), path, row_group_size=group, **options)


def made(seed=1):
    rng, rows = random.Random(seed), []
    for load in range(1, 7):
        for _ in range(100):
            loudness = rng.gauss(-12 if load != 2 else -30, 4)
            genre = rng.choice(["pop", "rock", "r&b", "hip-hop"] if load != 3 else ["folk", "pop"])
            rows.append({"load_id": load, "loudness": loudness, "popularity": rng.randint(0, 100), "genre": genre})
    for r in rows:
        if r["load_id"] == 4 and rng.random() < 0.3:
            r["genre"] = None
    rows[410]["genre"], rows[510]["loudness"], rows[20]["popularity"] = "Pop", math.nan, 101
    return rows


def brute(rows):
    out = set()
    for c in P.TRACK_CHECKS:
        import re

        ok = (lambda v: bool(re.fullmatch(r"[a-z]+([-&][a-z]+)?", v))) if c.pattern else (lambda v: c.low <= v <= c.high)
        for load in {r["load_id"] for r in rows}:
            own, rest = ([r[c.column] for r in rows if (r["load_id"] == load) == same] for same in (True, False))
            share = lambda xs: sum(x is None for x in xs) / len(xs)
            if rest and share(own) > share(rest) + 0.08:
                out.add((load, c.column, "nulls"))
            if any(v is not None and not ok(v) for v in own):
                out.add((load, c.column, "pattern" if c.pattern else "range"))
            a, b = ([v for v in xs if v is not None and ok(v)] for xs in (own, rest))
            if a and b:
                if c.pattern:
                    d = sum(abs(a.count(g) / len(a) - b.count(g) / len(b)) for g in {*a, *b}) / 2
                else:
                    d = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in {*a, *b})
                if d > 0.25:
                    out.add((load, c.column, "distribution"))
    return out


def found(spark, path):
    return {tuple(r) for r in P.findings(P.profile(spark, str(path))).collect()}


def test_against_brute_force(spark, tmp_path):
    rows = made()
    for name, group, options in [("aligned", 100, {}), ("mixed", 70, {}), ("plain", 100, {"use_dictionary": False, "write_statistics": False})]:
        write(tmp_path / f"{name}.parquet", rows, group, **options)
        assert found(spark, tmp_path / f"{name}.parquet") == brute(rows), name


def test_edges(spark, tmp_path):
    one = [{"load_id": 1, "loudness": -5.0, "popularity": 3, "genre": "pop"}] * 5
    write(tmp_path / "one.parquet", one)
    assert found(spark, tmp_path / "one.parquet") == set()
    write(tmp_path / "empty.parquet", [])
    assert found(spark, tmp_path / "empty.parquet") == set()
    nulls = [{"load_id": 2, "loudness": None, "popularity": None, "genre": None}] * 5
    write(tmp_path / "nulls.parquet", one + nulls, 5)
    assert found(spark, tmp_path / "nulls.parquet") == {(2, c, "nulls") for c in ("loudness", "popularity", "genre")}
    row = P.profile(spark, str(tmp_path / "nulls.parquet")).filter("load_id = 1 AND column_name = 'popularity'").first()
    assert (row["rows"], row["nulls"], row["distinct_values"], row["low"], row["high"]) == (5, 0, 1, "3.0", "3.0")


def test_footers(spark, tmp_path):
    rows = made()
    for codec in ("snappy", "zstd", "none"):
        write(tmp_path / "f.parquet", rows, 100, compression=codec)
        facts = chunk_facts(spark, [f"file://{tmp_path}/f.parquet"], "load_id", ["genre", "popularity"], ["genre", "popularity"]).collect()
        for f in facts:
            own = [r[f["column_name"]] for r in rows[f["row_group"] * 100 : f["row_group"] * 100 + 100]]
            assert f["nulls"] == sum(v is None for v in own)
            assert set(f["entries"]) == {str(v) for v in own if v is not None}
            assert f["key_low"] == f["key_high"] == str(f["row_group"] + 1)


def test_chunks_that_footers_settle_are_not_scanned(spark, tmp_path, monkeypatch):
    """A table clustered by load: constant and empty chunks are told by their footers; the rest is scanned, and only that."""
    rows = []
    for load in range(1, 9):
        for i in range(100):
            rows.append({"load_id": load, "loudness": None if load == 3 else -10.0, "popularity": 7 if load < 7 else i % 50, "genre": "pop" if load != 5 else "Bad One"})
    write(tmp_path / "c.parquet", rows, 100)
    table = spark.read.parquet(str(tmp_path / "c.parquet"))
    told = P.chunk_decisions(spark, table, "load_id", ["loudness", "popularity", "genre"]).collect()
    assert len(told) == 24 and sum(r["settled"] for r in told) == 22 and all(r["one_load"] for r in told)
    assert {(r["row_group"], r["column_name"]) for r in told if not r["settled"]} == {(6, "popularity"), (7, "popularity")}
    assert found(spark, tmp_path / "c.parquet") == brute(rows)
    done = {(r["load"], r["column_name"]) for r in P.settled_loads(spark.createDataFrame(told), "int")}
    assert done == {(load, c) for load in range(1, 9) for c in ("loudness", "popularity", "genre")} - {(7, "popularity"), (8, "popularity")}
    row = P.profile(spark, str(tmp_path / "c.parquet")).filter("load_id = 3 AND column_name = 'loudness'").first()
    assert (row["rows"], row["nulls"], row["distinct_values"]) == (100, 100, 0)
    write(tmp_path / "mixed.parquet", rows, 150)  # row groups of several loads settle none of these
    facts = P.chunk_decisions(spark, spark.read.parquet(str(tmp_path / "mixed.parquet")), "load_id", ["genre"])
    assert {r["load"] for r in P.settled_loads(facts, "int")} == set() and found(spark, tmp_path / "mixed.parquet") == brute(rows)
    plain = tmp_path / "p.parquet"  # without statistics nothing is settled
    write(plain, rows, 100, use_dictionary=False, write_statistics=False)
    assert not any(r["settled"] for r in P.chunk_decisions(spark, spark.read.parquet(str(plain)), "load_id", ["genre"]).collect())
    assert found(spark, plain) == brute(rows)
