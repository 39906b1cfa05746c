"""The payload's folder: order, bounded memory, commits, reading by point and group, one document."""

import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from caselattice.plans import compile as plan
from caselattice.plans import payload


def points(spark, n, parts=7):
    fields = {"id": F.concat(F.lit("C"), F.col("id")), "cluster": (F.col("id") % 3).cast("int"), "summary": F.concat(F.lit("text </b> ünïcode \n "), F.col("id")), "x": F.col("id") / 4, "date": F.lit("")}
    schema = spark.createDataFrame([], payload.POINT).schema
    return spark.range(n, numPartitions=parts).orderBy(F.xxhash64("id")).select(F.col("id").alias("n"), *[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


HEAD = {"meta": {"source_file": "ä.csv"}, "departments": ["A"], "clusters": [{"id": 0}]}


def test_round_trip(spark, tmp_path):
    out = payload.write_payload(points(spark, 100), HEAD, str(tmp_path / "p"))
    assert len(out["points"]) == 100 and [p["id"] for p in out["points"]] == [f"C{i}" for i in range(100)]
    one = json.loads("".join(out.text()))
    assert list(one) == ["meta", "departments", "clusters", "points"] and one["meta"] == HEAD["meta"] and len(one["points"]) == 100
    names = [f.name for f in spark.createDataFrame([], payload.POINT).schema]
    assert list(one["points"][7]) == names and one["points"][7]["summary"] == "text </b> ünïcode \n 7" and one["points"][7]["house"] is None
    again = payload.Payload(spark, str(tmp_path / "p"))
    assert again.point("C42")["x"] == 10.5 and again.members(1).count() == 33 and again.members(9).count() == 0
    with pytest.raises(ValueError):
        again.point("nobody")
    with pytest.raises(ValueError):
        payload.Payload(spark, str(tmp_path / "none"))
    assert "PushedFilters: [IsNotNull(cluster), EqualTo(cluster,1)]" in again.members(1)._jdf.queryExecution().toString()


def test_page(spark, tmp_path):
    out = payload.write_payload(points(spark, 5), HEAD, str(tmp_path / "p"))
    page = "".join(payload.injected(out.text(), f"<html>{payload.START}old{payload.END} {payload.START}kept{payload.END}</html>"))
    assert page == plan.inject("".join(out.text()).replace("</", "<\\/"), f"<html>{payload.START}old{payload.END} {payload.START}kept{payload.END}</html>")
    inner = page[page.index(payload.START) + len(payload.START):page.index(payload.END)]
    assert "</" not in inner and len(json.loads(inner)["points"]) == 5 and payload.injected(out.text(), "<html></html>") is None


def test_commits(spark, tmp_path):
    """A write that fails leaves what was there; the folder before the last one goes, the last one stays for its readers."""
    path = str(tmp_path / "p")
    first = payload.write_payload(points(spark, 3), HEAD, path)
    with pytest.raises(Exception):
        payload.write_payload(points(spark, 4).withColumn("house", F.raise_error(F.lit("no")).cast("string")), HEAD, path)
    assert len(payload.Payload(spark, path)["points"]) == 3
    payload.write_payload(points(spark, 5), HEAD, path)
    assert len(list(first["points"])) == 3
    payload.write_payload(points(spark, 0), HEAD, path)
    assert len(payload.Payload(spark, path)["points"]) == 0 and json.loads("".join(payload.Payload(spark, path).text()))["points"] == []
    with pytest.raises(Exception):
        list(first["points"])


def test_a_million_points_in_bounded_memory(spark, tmp_path):
    tracemalloc.start()
    out = payload.write_payload(points(spark, 1_000_000, 8), HEAD, str(tmp_path / "p"))
    taken = sum(1 for _ in zip(range(20_000), out["points"].lines()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out["points"]) == 1_000_000 and taken == 20_000 and peak < 30 << 20
    firsts = out["points"].spark.read.text(out["points"].folder).groupBy(F.input_file_name().alias("f")).agg(F.min(F.get_json_object("value", "$.x").cast("double")).alias("a"), F.max(F.get_json_object("value", "$.x").cast("double")).alias("b")).orderBy("f").collect()
    assert all(p["b"] < q["a"] for p, q in zip(firsts, firsts[1:]))
