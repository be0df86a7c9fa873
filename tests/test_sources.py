import json

import pytest
from pyspark.sql import functions as F

from trackloom.operators import validate
from trackloom.schema import RECORD_FIELDS
from trackloom.sources import catalogue, csv_io, datagen
from trackloom.streaming.ingest import start_load


def test_csv_round_trip(spark, tmp_path):
    made = datagen.generate(spark, 300, seed=7).orderBy("row_num")
    made = made.withColumn("title", F.when(F.col("row_num") == 5, F.lit('a "b",\nc')).otherwise(F.col("title")))
    rows = made.select(*RECORD_FIELDS)
    csv_io.write_csv(rows.coalesce(1), str(tmp_path / "t"))
    back = csv_io.read_csv(spark, str(tmp_path / "t")).orderBy("row_num").collect()
    assert [r["row_num"] for r in back] == list(range(1, 301)) and back[4]["title"] == 'a "b",\nc'
    assert [r["id"] for r in back] == [r["id"] for r in rows.collect()]


def test_generator(spark):
    made = datagen.generate(spark, 4000)
    assert made.collect() == datagen.generate(spark, 4000).collect()
    summary = validate.load_summary(validate.validated(made)).first()
    assert 0.005 * 4000 < summary["rejected"] < 0.05 * 4000 and summary["total"] == 4000


@pytest.fixture
def remote(tmp_path):
    tracks = [{"id": f"t{i}", "trackTitle": f"Blue {i}", "artists": [{"name": "Ann"}], "durationMs": 1000 + i, "popularity": i, "href": None} for i in range(30)]
    tracks += [{"id": "", "trackTitle": "Blue none", "artists": []}, {"id": "t3", "trackTitle": "Red 3", "artists": [{"name": None}]}]
    (tmp_path / "c.json").write_text(json.dumps(tracks))
    return str(tmp_path / "c.json")


def test_catalogue(spark, remote):
    hits = catalogue.search_catalogue(spark, remote, ["blue", "red"], limit=5).collect()
    assert [(r["query"], r["item"], r["id"]) for r in hits if r["query"] == "blue"] == [("blue", i, f"t{i}") for i in range(5)]
    assert {r["id"] for r in catalogue.lookup_catalogue(spark, remote, ["t1", "t2", "zz"]).collect()} == {"t1", "t2"}
    crawled = catalogue.crawl(spark, remote, ["red", "blue"], limit=8).collect()
    assert [r["id"] for r in crawled][:2] == ["t3", "t0"] and len(crawled) == 8
    with pytest.raises(Exception, match="catalogue request failed"):
        catalogue.search_catalogue(spark, remote + ".missing", ["x"]).collect()
    assert catalogue.search_catalogue(spark, remote + ".missing", ["x"], strict=False).count() == 0


def test_stream(spark, tmp_path):
    raw = spark.createDataFrame([(1, "a,b"), (2, "x1,T,A,g,,0,1,0.5,300,-60,0,0,0,0,1,11,0,7,100")], "line_id long, raw_line string")
    raw.write.parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema("line_id long, raw_line string").parquet(str(tmp_path / "in"))
    start_load(lines, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["x1"]
    assert [(r["line_id"], r["reasons"]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [(1, ["column_count"])]
