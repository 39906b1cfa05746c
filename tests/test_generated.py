"""Generated registers and workbooks: the same rows at any number of partitions, a round trip, failed writes."""

import datetime as dt
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caselattice.sources import generator, tabular, xlsx


def test_same_rows_whatever_the_partitions(spark):
    one = [tuple(r) for r in generator.sample_register(spark, 700).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        pool = generator.sample_pool(spark).repartition(9)
        assert [tuple(r) for r in generator.sample_register(spark, 700, pool=pool).collect()] == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    size = generator.sample_pool(spark).count()
    assert len(one) == 700 > size and [(r[1], r[0]) for r in one] == sorted((r[1], r[0]) for r in one)
    assert len({r[3] for r in one}) == 700 and len({r[0] for r in one}) == 700
    few = generator.sample_register(spark, 100, seed=7).collect()
    assert len({r.Case_Summary for r in few}) == 100 and {r.Case_Summary for r in few} <= {r.summary for r in generator.sample_pool(spark).collect()}
    assert {r.Case_Summary for r in few} != {r.Case_Summary for r in generator.sample_register(spark, 100, seed=8).collect()}
    day = dt.date(2025, 1, 6)
    assert all(day <= r[1] < day + dt.timedelta(days=365) for r in one) and len({r[2] for r in one}) == len(generator.DEPARTMENTS)
    many = Counter(r.Severity_Score for r in generator.sample_register(spark, 20_000).collect())
    assert all(abs(many[g + 1] / 200 - share) < 2 for g, share in enumerate(generator.SEVERITY_SHARES))
    assert generator.sample_register(spark, 0).count() == 0 and generator.sample_register(spark, 5, pool=pool.where("false")).count() == 0


def test_round_trip(spark, tmp_path):
    df = generator.sample_register(spark, 60).drop("mode")
    assert xlsx.write_xlsx(df, str(tmp_path / "r.xlsx"), "M&M Minutes") == 60
    back = tabular.load_register(spark, str(tmp_path / "r.xlsx")).collect()
    want = {r.Case_ID: r for r in df.collect()}
    assert len(back) == 60 and all((str(want[r.case_id].Date), want[r.case_id].Case_Summary, want[r.case_id].Severity_Score) == (str(r.date)[:10], r.case_summary, r.severity_score) for r in back)
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        assert z.testzip() is None and b"M&amp;M Minutes" in z.read("xl/workbook.xml")


def test_odd_cells_and_sheets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(xlsx, "MOST_ROWS", 11)
    odd = ["<b>&\"'</b>", None, " spaced ", "line\nbreak\r", "\x01\x0bgone", "", "é😀"]
    rows = [(i, odd[i % 7], i / 4 if i % 3 else None) for i in range(25)]
    df = spark.createDataFrame(rows, "id long, `t<x` string, x double").repartition(4).orderBy("id")
    assert xlsx.write_xlsx(df, str(tmp_path / "o.xlsx")) == 25
    data = (tmp_path / "o.xlsx").read_bytes()
    first = list(xlsx.sheet_rows(data))
    assert first[0] == ["id", "t<x", "x"] and len(first) == 11
    clean = lambda t: None if t is None else t.replace("\x01\x0b", "") or None
    for r, (i, t, x) in zip(first[1:], rows):
        r = (r + [None] * 3)[:3]
        assert r[0] == str(i) and clean(r[1]) == clean(t) and (r[2] is None) == (x is None) and (x is None or float(r[2]) == x)
    assert len(zipfile.ZipFile(tmp_path / "o.xlsx").namelist()) == 4 + 3
    assert xlsx.write_xlsx(df.where("false"), str(tmp_path / "e.xlsx")) == 0 and list(xlsx.sheet_rows((tmp_path / "e.xlsx").read_bytes())) == [["id", "t<x", "x"]]


def test_a_failed_write_leaves_the_file(spark, tmp_path):
    path = tmp_path / "k.xlsx"
    xlsx.write_xlsx(spark.range(3), str(path))
    before = path.read_bytes()
    with pytest.raises(Exception):
        xlsx.write_xlsx(spark.range(3).withColumn("t", F.raise_error(F.lit("no")).cast("string")), str(path))
    assert path.read_bytes() == before and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["k.xlsx"]


def test_reading_in_place(spark, tmp_path):
    """Shared texts in runs, gaps, names that are missing or come again, rows without cells, numbers and sheets in no order."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = "".join(f"<si>{x}</si>" for x in ("<t>Name</t>", "<r><t>two</t></r><r><t xml:space='preserve'> runs</t></r>", "<t/>"))
    sheet = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>0</v></c></row><row r="2"/><row r="3"><c r="C3" t="s"><v>1</v></c><c r="A3"><v>1.5</v></c><c r="AB3"><v>9</v></c></row><row r="4"><c><v>7</v></c><c t="s"><v>2</v></c></row>'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet10.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{shared}</sst>")
    df = xlsx.read_xlsx(spark, str(tmp_path / "s.xlsx"))
    assert df.columns == ["Name", "Unnamed: 1", "Name.1"]
    assert [tuple(r) for r in df.collect()] == [("1.5", None, "two runs"), ("7", "", None)]
    with zipfile.ZipFile(tmp_path / "n.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    assert xlsx.read_xlsx(spark, str(tmp_path / "n.xlsx")).columns == []
