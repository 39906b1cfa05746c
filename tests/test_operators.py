"""Properties of the operators on small made-up data."""

import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselattice.functions import scalars as S
from caselattice.operators import clustering, geometry, resampling, similarity, taxonomy, text_naming
from caselattice.plans import compile as plan
from caselattice.sources import store as stores
from caselattice.sources import tabular
from caselattice.streaming.learning import learn_stream


def frame(spark, m, labels):
    return spark.createDataFrame([(i, int(c), [float(x) for x in v]) for i, (v, c) in enumerate(zip(m, labels))], "id long, label int, v array<double>")


def blobs(sep=6.0, n=20, dims=3, seed=1):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=(n, dims)) * 0.5 + sep * np.eye(dims)[c % dims] for c in range(3)]), np.repeat([0, 1, 2], n)


def test_knn_against_numpy_in_many_blocks(spark):
    m = np.random.default_rng(2).normal(size=(57, 5))
    got = {(r.i, r.rank): r.j for r in similarity.knn(frame(spark, m, [0] * 57), 3, block_rows=10).collect()}
    sims = m @ m.T
    np.fill_diagonal(sims, -np.inf)
    for i in range(57):
        assert [got[i, k] for k in (1, 2, 3)] == np.argsort(-sims[i])[:3].tolist()


def test_knn_ties_go_to_the_smaller_id(spark):
    got = similarity.knn(frame(spark, np.ones((5, 2)), [0] * 5), 2).collect()
    assert {(r.i, r.rank): r.j for r in got}[4, 1] == 0 and {(r.i, r.rank): r.j for r in got}[0, 2] == 2
    assert similarity.knn(frame(spark, np.ones((1, 2)), [0])).count() == 0


def test_agreement_on_blobs_and_noise(spark):
    r = similarity.agreement(frame(spark, *blobs())).first()
    assert r.agreement > 0.9 and r.lift > 2.5
    rng = np.random.default_rng(3)
    assert similarity.agreement(frame(spark, rng.normal(size=(90, 3)), rng.integers(0, 3, 90))).first().lift < 1.9


def test_borderline_and_reasons(spark):
    m, c = blobs()
    why = similarity.justification(frame(spark, np.vstack([m, [[3, 3, 0]]]), [*c, 0]))
    rows = {r.id: r for r in why.withColumn("reason", plan.text_reason(why)).collect()}
    assert abs(rows[60].margin) < 0.1 and rows[0].neighbours_agreeing == 3 and "three nearest" in rows[0].reason


def test_silhouette_and_cohesion_against_numpy(spark):
    m, c = blobs(2.0)
    far = np.linalg.norm(m[:, None] - m[None], axis=2)
    s = []
    for i in range(len(m)):
        a = far[i][(c == c[i]) & (np.arange(len(m)) != i)].mean()
        b = min(far[i][c == o].mean() for o in set(c) - {c[i]})
        s.append((b - a) / max(a, b))
    assert abs(similarity.silhouette(frame(spark, m, c), block_rows=7).first().silhouette - np.mean(s)) < 1e-3
    got = {r.label: r.cohesion for r in similarity.cohesion(frame(spark, m, c)).collect()}
    g = m[c == 1] @ m[c == 1].T
    assert abs(got[1] - g[np.triu_indices(20, 1)].mean()) < 1e-3
    assert similarity.cohesion(frame(spark, m[:1], [0])).first().cohesion == 1.0


def test_geometry(spark):
    rng = np.random.default_rng(4)
    m = np.concatenate([rng.normal(size=(20, 3)) * 0.05 + c for c in ((0, 0, 0), (1, 0, 0), (0, 1, 0))])
    pts = spark.createDataFrame([(i, i // 20, *map(float, v)) for i, v in enumerate(m)], "id long, label int, x double, y double, z double")
    scaled = geometry.rescale(pts)
    top = scaled.agg(*[F.max(F.abs(a)).alias(a) for a in "xyz"]).first()
    assert abs(max(top) - 100) < 1e-6
    moved, gain = geometry.separate(pts)
    assert gain > 1 and geometry.least_gap(moved) > 0
    far = lambda df: np.array([[r.x, r.y, r.z] for r in df.where("label = 0").orderBy("id").collect()])
    a, b = far(pts), far(moved)
    ratio = [np.linalg.norm(b[i] - b[0]) / np.linalg.norm(a[i] - a[0]) for i in range(1, 20)]
    assert max(ratio) - min(ratio) < 1e-6
    assert geometry.separate(scaled)[1] == 1.0 if geometry.least_gap(scaled) >= 45 else True
    core = geometry.core_members(pts).groupBy("label").count().collect()
    assert {r["count"] for r in core} == {14}
    assert geometry.rescale(pts.where("id = 3")).first().x == 0


def test_labels_cleaned(spark):
    cases = {
        "Medication dosing errors": "Medication dosing errors", "  \"delays reaching theatre.\"\nmore": "Delays reaching theatre", "Sure, here is one": None, "I cannot name this": None,
        "Case 14 delays": None, "Delays": None, "one two three four five six seven": None, "a, b, c": None, "First. Then another": None, "x" * 30 + " " + "y" * 30: None, "": None, None: None,
        "lost   results": "Lost results",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string").withColumn("got", S.clean_label(F.col("raw")))
    assert [(r.raw, r.got) for r in df.collect()] == list(cases.items())


def test_severity(spark):
    cases = {"None": 1, " Near Miss ": 1, "catastrophic": 5, "4.9": 4, "9": 5, "-2": 1, "nan": 3, "Infinity": 5, "so-so": 3, None: 3}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want int").withColumn("got", S.severity(F.col("raw")))
    assert all(r.got == r.want for r in df.collect())


HEADER = ["Datix Ref", "Date of Incident", "Specialty", "What Happened?", "Grade of Harm"]


def export_rows(n=12):
    return [[f"MM-{i:03d}", f"{i + 1:02d}/03/2025", "Théâtre" if i % 2 else "", f"Case {i}; a long \"narrative\", with several words and\na second line", ["None", "Low", "Major"][i % 3]] for i in range(n)]


@pytest.mark.parametrize("suffix,sep,encoding", [("csv", ",", "utf-8"), ("csv", ",", "utf-8-sig"), ("csv", ";", "cp1252"), ("tsv", "\t", "utf-8"), ("txt", ";", "utf-8")])
def test_delimited_registers(spark, tmp_path, suffix, sep, encoding):
    import csv

    path = tmp_path / f"export.{suffix}"
    with open(path, "w", encoding=encoding, newline="") as f:
        csv.writer(f, delimiter=sep).writerows([HEADER, *export_rows()])
    rows = tabular.load_register(spark, str(path)).orderBy("case_id").collect()
    assert len(rows) == 12 and rows[0].severity_score == 1 and rows[2].severity_score == 4
    assert rows[1].department == "Théâtre" and rows[0].department == "Unspecified" and str(rows[0].date.date()) == "2025-03-01" and "\n" in rows[0].case_summary


def workbook(path, rows):
    cells = lambda r, i: "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t xml:space="preserve">{v}</t></is></c>' for j, v in enumerate(r) if v != "")
    body = "".join(f'<row r="{i}">{cells(r, i)}</row>' for i, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "export.xlsx")
    workbook(path, [HEADER, *[[c.replace("\n", " ").replace('"', "") for c in r] for r in export_rows()]])
    rows = tabular.load_register(spark, path).orderBy("case_id").collect()
    assert len(rows) == 12 and rows[0].severity_score == 1 and rows[0].department == "Unspecified"


def test_columns_found(spark):
    df = spark.createDataFrame([("x" * 10, "y" * 100, "z")], "Summary string, `Full Narrative` string, Ward string")
    assert tabular.resolve_columns(df)["Case_Summary"] == "Summary"
    assert tabular.resolve_columns(df, {"Case_Summary": "Full Narrative"})["Case_Summary"] == "Full Narrative"
    with pytest.raises(ValueError):
        tabular.resolve_columns(df, {"Date": "nowhere"})
    free = spark.createDataFrame([("x" * 50, "y" * 100)], "p string, q string")
    assert tabular.resolve_columns(free)["Case_Summary"] == "q"
    with pytest.raises(ValueError):
        tabular.read_tabular(spark, "notes.docx")
    few = spark.createDataFrame([("only one",)], "text string")
    with pytest.raises(ValueError):
        tabular.normalise(few)
    ids = tabular.normalise(spark.createDataFrame([(f"case {i}" if i != 3 else " ",) for i in range(12)], "text string").coalesce(1)).orderBy("case_id").collect()
    assert [r.case_id for r in ids][:4] == ["ROW-0001", "ROW-0002", "ROW-0003", "ROW-0005"] and ids[0].severity_score == 3


def test_names_of_groups(spark):
    rows = [(i, 0, f"theatre list delay again theatre list overran today {i}") for i in range(8)] + [(10 + i, 1, f"insulin dose wrong insulin dose missed {i} contact") for i in range(8)] + [(30, 2, "alone"), (31, 2, "other words entirely")]
    docs = spark.createDataFrame(rows, "id long, label int, text string")
    got = {r.label: r for r in text_naming.name_groups(docs).collect()}
    assert "Theatre" in got[0].name and "Insulin" in got[1].name and got[2].name == "Group 3" and got[2].label_source == "numbered"
    assert got[0].coverage >= 0.2 and not {*got[0].keywords} & {*got[1].keywords}
    assert spark.range(1).select(text_naming.titled(F.lit("ct scan"))).first()[0] == "CT Scan"
    cover = text_naming.term_coverage(docs, spark.createDataFrame([(1, "ct"), (1, "insulin")], "label int, term string")).collect()
    assert {r.term: r.coverage for r in cover} == {"ct": 0.0, "insulin": 1.0}


def test_greedy_terms(spark):
    rows = [(0.9, 0, "theatre list", 0.5), (0.8, 0, "theatre", 0.9), (0.7, 1, "theatre list", 0.4), (0.6, 1, "delay", 0.3)]
    got = text_naming.assign_terms(spark.createDataFrame(rows, "score double, label int, term string, coverage double")).collect()
    assert {(r.label, r.term, r.coverage) for r in got} == {(0, "theatre list", 0.5), (1, "delay", 0.3)}


def test_taxonomy(spark):
    axis = np.eye(3)
    taught = spark.createDataFrame([(f"L{a}", axis[a].tolist()) for a in range(3) for _ in range([5, 8, 4][a])], "label string, v array<double>")
    bank = taxonomy.learn(None, taught)
    assert {r.label: r.n for r in bank.collect()} == {"L0": 5, "L1": 8, "L2": 4}
    v = frame(spark, [[1, 0.1, 0], [1, 1, 0], [0, 0, 1], [0, 0, 0]], [0] * 4)
    got = {r.id: r for r in taxonomy.classify(v, bank).collect()}
    assert got[0].label == "L0" and got[1].label is None and got[1].candidate_label == "L0" and got[1].withheld_at_default and got[2].label is None
    assert taxonomy.classify(v, bank.limit(0)).where("candidate_label is not null").count() == 0
    more = taxonomy.learn(bank, taught.where("label = 'L2'"))
    assert {r.label: r.n for r in more.collect()}["L2"] == 8
    filed = spark.createDataFrame([("k1", "mine")], "case_key string, filed_label string")
    keys = spark.createDataFrame([(i, f"k{i}") for i in range(4)], "id long, case_key string")
    h = {r.id: r for r in taxonomy.with_filed(taxonomy.classify(v, bank), keys, filed).collect()}
    assert h[1].label == "mine" and h[1].source == "human" and h[1].confidence == 1.0 and h[1].margin is None
    preds = spark.createDataFrame([(1, "a", 0.15, 0.01, None, "a", True, "taxonomy"), (2, "b", 0.5, 0.1, "b", "b", False, "taxonomy"), (3, "h", 1.0, None, "h", "h", False, "human")], "id int, c string, confidence double, margin double, label string, candidate_label string, withheld_at_default boolean, source string")
    loose = {r.id: r for r in taxonomy.gate(preds, "exploring").collect()}
    strict = {r.id: r for r in taxonomy.gate(preds, "acting_on_it").collect()}
    assert loose[1].label == "a" and loose[1].is_guess and strict[1].label is None and strict[2].label == "b" and strict[3].label == "h"
    with pytest.raises(ValueError):
        taxonomy.gate(preds, "certain")


def test_names_restored(spark):
    at = lambda c: [c, (1 - c * c) ** 0.5, 0.0]
    stored = spark.createDataFrame([("old", "fp0", [1.0, 0.0, 0.0]), ("exact", "fp1", [0.0, 0.0, 1.0])], "name string, fingerprint string, v array<double>")
    groups = spark.createDataFrame([(0, "x", at(0.95)), (1, "y", at(0.97)), (2, "fp1", [0.0, 1.0, 0.0])], "cluster int, fingerprint string, v array<double>")
    got = {r.cluster: r for r in taxonomy.restore_names(groups, stored).collect()}
    assert got[0].match == "carried_over" and got[0].drift and got[1].name is None and got[2].match == "exact" and got[2].similarity == 1.0
    one = {r.cluster: r for r in taxonomy.restore_names(groups.where("cluster = 1"), stored).collect()}
    assert one[1].name == "old" and not one[1].drift


def test_constraints(spark):
    m, c = blobs()
    v = frame(spark, m, c)
    links = spark.createDataFrame([(0, 31, "same"), (0, 1, "different"), (5, 6, "same"), (6, 7, "same"), (5, 7, "different")], "id_a long, id_b long, kind string")
    got, violated = clustering.constrained(v, 3, links)
    where = {r.id: r.cluster for r in got.collect()}
    assert len(where) == 60 and where[0] == where[31] and where[0] != where[1] and where[5] == where[7] and not violated
    comps = clustering.link_components(v.select("id"), links.where("kind = 'same'"))
    rep = {r.kind: r for r in clustering.constraint_report(links, comps, got).collect()}
    assert rep["same"].honoured == 3 and rep["different"].contradictory == 1 and rep["different"].honoured == 1 and rep["different"].violated == 0
    clique = spark.createDataFrame([(a, b, "different") for a in range(3) for b in range(a)], "id_a long, id_b long, kind string")
    assert clustering.constrained(v, 2, clique)[1] >= 1
    plain = clustering.cluster(v, 3).select("id", "cluster")
    assert plain.select("cluster").distinct().count() == 3


def test_links_match_cases(spark):
    cases = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "id long, case_key string")
    links = spark.createDataFrame([("a", "b", "same"), ("a", "a", "same"), ("a", "gone", "same")], "case_a string, case_b string, kind string")
    assert [tuple(r) for r in clustering.matched_links(cases, links).collect()] == [(0, 2, "same")]


def test_quality_report(spark):
    m, c = blobs(6.0, 15)
    good = resampling.report(frame(spark, m, c), 3, rounds=2).first()
    assert good.stability > 0.8 and good.lift > 2 and good.checks_passed >= 2
    assert resampling.stability(frame(spark, m[:5], [0] * 5), 3).first().stability is None
    mixed = resampling.column_shuffled(frame(spark, m, c)).orderBy("id").collect()
    assert np.allclose(np.sort(np.array([r.v for r in mixed]), 0), np.sort(m, 0)) and not np.allclose([r.v for r in mixed], m)


def test_pairs_are_counted_by_common_rounds():
    rng = np.random.default_rng(7)
    masks = rng.integers(0, 32, 60)
    want = np.zeros(6)
    for a in masks:
        for b in masks:
            want[bin(a & b).count("1")] += 1
    counts = {int(m): int((masks == m).sum()) for m in set(masks.tolist())}
    assert (resampling._pairs_by_common(counts, 5) == want).all()


def test_stability_against_pairs(spark, monkeypatch):
    m, c = blobs(1.2, 15)
    fits = {}
    real = resampling.kmeans

    def spy(points, k, restarts, seed):
        out = real(points, k, restarts, seed)
        fits[len(fits)] = {r.id: r.cluster for r in out[0].collect()}
        return out

    monkeypatch.setattr(resampling, "kmeans", spy)
    got = resampling.stability(frame(spark, m, c), 3, rounds=3).first().stability
    base, rounds = fits[0], [fits[i] for i in (1, 2, 3)]
    shares = []
    for a in base:
        for b in base:
            both = [r for r in rounds if a in r and b in r]
            if a != b and base[a] == base[b] and both:
                shares.append(np.mean([r[a] == r[b] for r in both]))
    assert abs(got - np.mean(shares)) < 1e-4


def test_store(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "store"))
    assert stores.summary(s)["events"] == 0 and s.filed().count() == 0
    key = s.label_case("A  Case text", "first")
    assert key == s.label_case(" a case TEXT ", "second") and s.filed().first().filed_label == "second"
    s.link_cases("b", "a", "same")
    s.link_cases("a", "b", "different")
    assert s.links().count() == 1 and s.links().first().kind == "different"
    with pytest.raises(ValueError):
        s.link_cases("a", "b", "maybe")
    fp = s.save_name(["k2", "k1"], "Delays", [1.0, 0.0])
    assert fp == s.save_name(["k1", "k2"], "Late", [1.0, 0.0]) and s.read("group_names").first().name == "Late"
    s.learn(spark.createDataFrame([("L", [1.0, 2.0])] * 3, "label string, v array<double>"))
    s.learn(spark.createDataFrame([("L", [1.0, 2.0])] * 2, "label string, v array<double>"))
    got = stores.summary(s)
    assert got["taxonomy"] == {"L": 5} and got["ready"] == ["L"] and s.read("label_centroids").first().vector_sum == [5.0, 10.0]
    for t in stores.SCHEMAS:
        assert "case text" not in json.dumps([r.asDict() for r in s.read(t).collect()], default=str).lower()


def test_history(spark):
    runs = spark.createDataFrame([(1, "t", 5, 0.72, 0.70, 0.2), (2, "t", 6, 0.44, 0.57, 0.2), (3, "t", 5, 0.70, 0.69, 0.2), (4, "t", 7, None, 0.9, 0.2)], "run_id long, created_at string, k int, stability double, agreement double, chance double")
    best = stores.best_k(runs).first()
    assert (best.k, best.runs, best.stability) == (5, 2, 0.71)
    assert stores.best_k(runs.where("k = 5")).count() == 0
    assert [r.run_id for r in stores.run_history(runs, 2).collect()] == [4, 3]


def test_learning_stream(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "store"))
    spark.createDataFrame([("L", [1.0, 0.0])] * 4, "label string, v array<double>").write.parquet(str(tmp_path / "in"))
    stream = lambda: learn_stream(spark.readStream.schema("label string, v array<double>").parquet(str(tmp_path / "in")), s, str(tmp_path / "cp")).awaitTermination()
    stream()
    spark.createDataFrame([("L", [1.0, 0.0])] * 2, "label string, v array<double>").write.mode("append").parquet(str(tmp_path / "in"))
    stream()
    stream()
    assert stores.summary(s)["taxonomy"] == {"L": 6}


def test_whole_run(spark, tmp_path):
    rng = random.Random(1)
    kinds = ["insulin dose given twice and sugar dropped", "theatre list delayed for hours by missing staff", "scan result was never read by the team on call"]
    rows = [(f"C{i:02d}", f"2025-01-{i % 28 + 1:02d}", ["A", "B"][i % 2], f"{kinds[i % 3]} {rng.choice(['monday', 'friday'])} {rng.random()}", str(i % 5 + 1)) for i in range(36)]
    reg = tabular.normalise(spark.createDataFrame(rows, "Case_ID string, Date string, Department string, Case_Summary string, Severity_Score string"))
    s = stores.Store(spark, str(tmp_path / "store"))
    s.label_case(rows[0][3], "Insulin")
    out = plan.compile_register(spark, reg, 3, store=s, rounds=1)
    assert len(out["points"]) == 36 and len(out["clusters"]) == 3 and out["departments"] == ["A", "B"]
    p = {x["id"]: x for x in out["points"]}
    assert set(p["C00"]) == {"id", "x", "y", "z", "tx", "ty", "tz", "cluster", "department", "severity", "date", "summary", "nearest", "house", "house_confidence", "house_margin", "house_candidate", "house_withheld", "house_source", "why"}
    assert p["C00"]["house"] == "Insulin" and p["C00"]["house_source"] == "human" and p["C00"]["house_candidate"] is None and len(p["C00"]["nearest"]) == 3
    assert all(len({p[f"C{i:02d}"]["cluster"] for i in range(k, 36, 3)}) == 1 for k in range(3))
    assert s.read("runs").count() == 1 and s.read("assignments").count() == 36 and out["meta"]["qc"]["agreement"] > 0.9
    page = plan.inject(json.dumps(out), f"<html>{plan.START}old{plan.END}</html>")
    assert '"points"' in page and "old" not in page and plan.inject("x", "<html></html>") is None


def test_workbench(spark, tmp_path, monkeypatch):
    import csv

    figures = {"agreement": 1.0, "chance": 0.5, "lift": 2.0, "stability": 1.0, "rounds": 1, "silhouette": 0.5, "shuffled_silhouette": 0.1, "beats_noise": True, "checks_passed": 3, "verdict": "structure found"}
    monkeypatch.setattr(resampling, "report", lambda v, k, rounds, seed: spark.createDataFrame([figures]))  # tested elsewhere

    from caselattice.__main__ import main
    from caselattice.plans.workbench import Workbench

    path = str(tmp_path / "export.csv")
    kinds = ["insulin dose given twice and sugar dropped", "theatre list delayed for hours by missing staff"]
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([["Ref", "What Happened?", "Ward"], *[[f"C{i:02d}", f"{kinds[i % 2]} {i} x{i * 7}", "A"] for i in range(20)]])
    w = Workbench(spark, stores.Store(spark, str(tmp_path / "store")), k=1, rounds=1)
    with pytest.raises(ValueError):
        w.rebuild()
    with pytest.raises(ValueError):
        w.ingest(path, most_bytes=10)
    out = w.ingest(path)
    assert w.k == 2 and len(out["points"]) == 20
    group = w.point("C00")["cluster"]
    out = w.name_group(group, "  Insulin   errors ")
    assert {c["id"]: c["label"] for c in out["clusters"]}[group] == "Insulin errors" and out["clusters"][group]["label_source"] == "human"
    assert sum(p["house"] == "Insulin errors" for p in out["points"]) >= 7
    out = w.file_cases(["C01", "C01", "C03"], "Delays")
    assert w.point("C01")["house"] == "Delays" and w.point("C01")["house_source"] == "human"
    for bad in (lambda: w.file_cases(["nobody"], "x"), lambda: w.file_cases([], "x"), lambda: w.name_group(group, "y" * 61), lambda: w.name_group(99, "x")):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "t.html").write_text(f"<html>{plan.START}{plan.END}</html>")
    args = ["--input", path, "--clusters", "2", "--rounds", "1", "--store", str(tmp_path / "s2"), "--output", str(tmp_path / "data.json"), "--template", str(tmp_path / "t.html"), "--page", str(tmp_path / "p.html")]
    assert main(args) == 0 and len(json.loads((tmp_path / "data.json").read_text())["points"]) == 20 and "points" in (tmp_path / "p.html").read_text()
    assert main([*args[:1], str(tmp_path / "t.html"), *args[2:]]) == 1


def test_filters_and_figures(spark):
    reg = spark.createDataFrame([(1, 0, "a", 5, "Fall on ward"), (2, 0, "b", 2, "fall"), (3, 1, "a", 4, "dose")], "id long, cluster int, department string, severity_score int, case_summary string")
    assert [r.id for r in plan.register_filter(reg, "FALL", 3, ["a"], 0).collect()] == [1]
    assert plan.register_filter(reg).count() == 3
    k = plan.kpis(reg).first()
    assert (k.cases, k.modes, k.largest_share, k.severe_share) == (3, 2, 0.6667, 0.6667)
    assert plan.bulk_select(reg, spark.createDataFrame([(1,), (1,), (9,)], "id long")).count() == 1
