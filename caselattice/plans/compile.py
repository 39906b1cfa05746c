"""From a register to the payload: embed, cluster, name, classify, project, check, record, emit."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import numbered
from ..functions.scalars import CONFIDENCE_LEVELS, case_key, clean_label, fingerprint, reason
from ..operators import clustering, geometry, layout, resampling, similarity, taxonomy, text_naming
from ..sources import store as stores
from .payload import END, START, Payload, injected, write_payload  # noqa: F401

#: Colours of groups.
PALETTE = ["#00B3B3", "#FF8A5B", "#9D8CFF", "#F2C14E", "#5BD1A0"]


def register_filter(register: DataFrame, search: str | None = None, least_severity: int | None = None, departments: list[str] | None = None, cluster: int | None = None) -> DataFrame:
    """The register narrowed by every filter that is given."""
    if search:
        register = register.where(F.contains(F.lower("case_summary"), F.lit(search.lower())))
    if least_severity is not None:
        register = register.where(F.col("severity_score") >= least_severity)
    if departments is not None:
        register = register.where(F.col("department").isin(departments))
    return register if cluster is None else register.where(F.col("cluster") == cluster)


def kpis(register: DataFrame) -> DataFrame:
    """One row: cases, modes, the largest mode's share and the share of severities 4 and 5. register: (cluster, severity_score)."""
    by = register.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(F.col("severity_score") >= 4).alias("severe"))
    return by.agg(F.sum("n").alias("cases"), F.count("*").alias("modes"), F.round(F.max("n") / F.sum("n"), 4).alias("largest_share"), F.round(F.sum("severe") / F.sum("n"), 4).alias("severe_share"))


def bulk_select(register: DataFrame, ids: DataFrame) -> DataFrame:
    """The cases of a list of ids (id), each once however often it is listed."""
    return register.join(ids.distinct(), "id", "left_semi")


def text_reason(why: DataFrame) -> Column:
    two = lambda c: F.round(c, 2)
    return reason(two(F.col("to_own")), two(F.col("to_next")), F.col("next_group"), F.col("neighbours_agreeing"))


def embed(register: DataFrame, model=None, dims: int = 64) -> DataFrame:
    """(id, label, v). model: a function of a pandas series of texts to vectors, run on Arrow batches; without one hashed tokens."""
    docs = register.select("id", F.lit(0).alias("label"), F.col("case_summary").alias("text"))
    if model is None:
        return text_naming.hashed_vectors(docs, dims)
    return docs.select("id", "label", F.pandas_udf(model, "array<double>")("text").alias("v"))


def points_payload(register: DataFrame, coords: DataFrame, true_coords: DataFrame, near: DataFrame, house: DataFrame, why: DataFrame, order: str | None = None) -> DataFrame:
    """One row a case, with the fields of a payload's point. order: the name of a column for the register's id. why: justification() with its margin as why_margin. register: id, case_id, date, department, case_summary, severity_score, cluster."""
    nearest = near.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "j", "sim"))), lambda s: F.struct(s["j"].alias("i"), F.round(s["sim"], 4).alias("sim"))).alias("nearest"))
    three = lambda df, p: df.select("id", *[F.round(a, 3).alias(f"{p}{a}") for a in geometry.AXES])
    met = register.join(three(coords, ""), "id").join(three(true_coords, "t"), "id").join(nearest.withColumnRenamed("i", "id"), "id", "left").join(house.withColumnRenamed("label", "house"), "id", "left").join(why.drop("label"), "id", "left")
    human = F.coalesce(F.col("source") == "human", F.lit(False))
    return met.select(
        *([F.col("id").alias(order)] if order else []), F.col("case_id").alias("id"), "x", "y", "z", "tx", "ty", "tz", "cluster", "department", F.col("severity_score").alias("severity"),
        F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("")).alias("date"), F.col("case_summary").alias("summary"), "nearest", "house",
        F.col("confidence").alias("house_confidence"), F.col("margin").alias("house_margin"), F.when(~human, F.col("candidate_label")).alias("house_candidate"),
        F.when(~human, F.col("withheld_at_default")).alias("house_withheld"), F.when(F.col("house").isNotNull(), F.coalesce("source", F.lit("taxonomy"))).alias("house_source"),
        F.struct("to_own", "to_next", "next_group", F.col("why_margin").alias("margin"), "neighbours_agreeing", "borderline", "reason").alias("why"),
    )


def inject(payload: str, template: str) -> str | None:
    """The template with the first marked block holding the payload; None without markers."""
    a = template.find(START)
    b = template.find(END, a)
    return None if a < 0 or b < 0 else template[: a + len(START)] + payload + template[b:]


@contextmanager
def held(*frames: DataFrame) -> Iterator[list[DataFrame]]:
    """A list of cached tables, released at the end."""
    kept = list(frames)
    try:
        yield kept
    finally:
        for f in kept:
            f.unpersist()


def _asked(spark: SparkSession, namer, texts: list[str], used: set[str]) -> str | None:
    """The namer's answer as a clean label that no group has; asked a second time with the names to avoid. An error is no answer."""
    for avoid in (set(), used):
        try:
            answer = namer(texts, avoid)
        except Exception:
            return None
        label = spark.createDataFrame([(answer,)], "a string").select(clean_label(F.col("a")).alias("l")).first()["l"]
        if label and label.casefold() not in used:
            return label
    return None


def compile_register(spark: SparkSession, register: DataFrame, k: int = 5, seed: int = 42, store: stores.Store | None = None, rounds: int = resampling.ROUNDS, model=None, namer=None, source: str = "", vectors: DataFrame | None = None, projection: str = "pca") -> dict:
    """compiled(), for registers small enough to be one dict: its points are collected."""
    with held() as kept:
        head, points = compiled(kept, spark, register, k, seed, store, rounds, model, namer, source, vectors, projection)
        fields = [c for c in points.columns if c != "n"]
        rows = points.orderBy("n").select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).collect()
        return head | {"points": [json.loads(j) for (j,) in rows]}


def compile_to(path: str, spark: SparkSession, register: DataFrame, *args, **kwargs) -> Payload:
    """compiled(), written as the payload in a folder. Only the groups' rows pass through the driver."""
    with held() as kept:
        head, points = compiled(kept, spark, register, *args, **kwargs)
        return write_payload(points, head, path)


def compiled(kept: list[DataFrame], spark: SparkSession, register: DataFrame, k: int = 5, seed: int = 42, store: stores.Store | None = None, rounds: int = resampling.ROUNDS, model=None, namer=None, source: str = "", vectors: DataFrame | None = None, projection: str = "pca") -> tuple[dict, DataFrame]:
    """The whole run over a normalised register: {meta, departments, clusters}, and the points with ``n``, their order. vectors: (id, v), else embed() makes them.

    kept: gets the cached tables that points are read from, which the caller releases. namer: an optional function of
    (representative texts, names to avoid) to a label; groups of cohesion under 0.25 keep theirs. projection: ``pca``, or
    ``neighbours`` for the layout that keeps neighbours near.
    """
    if projection not in ("pca", "neighbours"):
        raise ValueError(f"projection must be pca or neighbours, not {projection!r}")

    def cached(df: DataFrame) -> DataFrame:
        kept.append(df.cache())
        return df

    cases = cached(numbered(register.orderBy("case_id", "case_summary"), "id").withColumn("id", F.col("id") - 1))
    n = cases.count()
    k = k if k <= n else max(2, n // 4)
    v = cached((vectors if vectors is not None else embed(cases, model)).select("id", "v"))
    links = clustering.matched_links(cases.select("id", case_key(F.col("case_summary")).alias("case_key")), store.links()) if store else None
    fit = cached(clustering.cluster(v, k, links, seed))
    labelled = cached(v.join(fit.select("id", F.col("cluster").alias("label")), "id"))
    docs = cached(cases.join(fit.select("id", F.col("cluster").alias("label")), "id").select("id", "label", F.col("case_summary").alias("text")))
    names = {r["label"]: r.asDict() for r in text_naming.name_groups(docs).collect()}
    cohesion = {r["label"]: r["cohesion"] for r in similarity.cohesion(labelled).collect()}
    nearest = {r["label"]: r for r in similarity.nearest_cluster(labelled).collect()}
    centres = {r["label"]: r["v"] for r in similarity.centroids(labelled).collect()}
    best = {r["label"]: (r["id"], r["text"]) for r in similarity.exemplars(labelled).join(docs.select("id", "text"), "id").collect()}
    if namer is not None:
        shown = similarity.representatives(labelled).join(docs.select("id", F.substr("text", F.lit(1), F.lit(220)).alias("text")), "id").collect()
        used: set[str] = set()
        for c in sorted(names, key=lambda c: -cohesion[c]):
            texts = [r["text"] for r in sorted(shown, key=lambda r: r["rank"]) if r["label"] == c]
            label = _asked(spark, namer, texts, used) if cohesion[c] >= 0.25 else None
            if label:
                used.add(label.casefold())
                names[c] |= {"name": label, "label_source": "model"}
    known = store.read("label_centroids").select("label", "vector_sum", "n") if store else spark.createDataFrame([], "label string, vector_sum array<double>, n long")
    filed = store.filed() if store else spark.createDataFrame([], "case_key string, filed_label string")
    keys = cached(cases.select("id", case_key(F.col("case_summary")).alias("case_key")))
    house = cached(taxonomy.with_filed(taxonomy.classify(v, known), keys, filed))
    for r in taxonomy.dominant_label(house.select("id", "label").join(fit.select("id", "cluster"), "id")).collect():
        names[r["cluster"]] |= {"name": r["label"], "label_source": "taxonomy", "label_agreement": r["share"]}
    drifted = 0
    if store and store.read("group_names").limit(1).count():
        prints = keys.join(fit.select("id", "cluster"), "id").groupBy("cluster").agg(fingerprint(F.collect_list("case_key")).alias("fingerprint"))
        groups = prints.join(similarity.centroids(labelled).select(F.col("label").alias("cluster"), "v"), "cluster")
        for r in taxonomy.restore_names(groups, store.read("group_names").select("name", "fingerprint", F.col("centroid").alias("v"))).collect():
            if r["name"]:
                names[r["cluster"]] |= {"name": r["name"], "label_source": "human" if r["match"] == "exact" else "human_carried", "label_match": r["match"], "label_similarity": r["similarity"], "label_drift": r["drift"]}
                drifted += bool(r["drift"])
    flat, variance = clustering.projected(v, 3) if projection == "pca" else (layout.layout(v, seed=seed), None)
    points = flat.join(fit.select("id", F.col("cluster").alias("label")), "id").select("id", "label", *[F.col("space")[i].alias(a) for i, a in enumerate(geometry.AXES)])
    kept.append(points.cache())
    true_points = geometry.rescale(points)
    moved, gain = geometry.separate(true_points)
    why = similarity.justification(labelled)
    why = cached(why.withColumn("reason", text_reason(why)))
    qc = resampling.report(labelled, k, rounds, seed).first().asDict()
    if store:
        label_of = spark.createDataFrame([(c, m["name"]) for c, m in names.items()], "cluster_id int, name string")
        assigned = why.select("id", F.col("label").alias("cluster_id"), "to_own", "to_next", "margin", F.col("neighbours_agreeing").alias("neighbours"), "borderline", "reason")
        assigned = assigned.join(label_of, "cluster_id").withColumnRenamed("name", "label").join(keys, "id")
        store.record_run({"source": source, "k": k, "n_cases": n, "silhouette": qc["silhouette"], "shuffled": qc["shuffled_silhouette"], "stability": qc["stability"], "agreement": qc["agreement"], "chance": qc["chance"], "verdict": qc["verdict"]}, assigned)
    full = cases.join(fit.select("id", "cluster"), "id")
    rows = points_payload(full, moved, true_points, similarity.knn(v), house, why.withColumnRenamed("margin", "why_margin"), "n")
    top = stores.best_k(store.read("runs")).first() if store else None
    clusters = [
        {"id": c, "label": m["name"], "label_coverage": m["coverage"], "label_source": m["label_source"], "centroid": [round(x, 5) for x in centres[c]], "color": PALETTE[c % len(PALETTE)], "size": m["size"], "keywords": m["keywords"],
         "exemplar": {"i": best[c][0], "text": best[c][1][:150]}, "cohesion": cohesion[c], "nearest_cluster": nearest[c]["nearest_cluster"], "nearest_similarity": nearest[c]["nearest_similarity"]} | {x: m[x] for x in m if x.startswith("label_") and x not in ("label_source",)}
        for c, m in sorted(names.items())
    ]
    meta = {
        "source_file": source, "n_cases": n, "n_clusters": len(clusters), "cluster_space_dims": clustering.DIMS, "separation_gain": round(gain, 3), "variance_retained": None if variance is None else round(sum(variance), 4),
        "projection": projection, "silhouette": qc["silhouette"], "qc": qc, "best_k": top.asDict() if top else None, "name_drift": drifted,
        "confidence": {level: {"min_confidence": a, "min_margin": b} for level, (a, b) in CONFIDENCE_LEVELS.items()},
        "constraints": [r.asDict() for r in clustering.constraint_report(links, clustering.link_components(v.select("id"), links.where("kind = 'same'")), fit.select("id", "cluster")).collect()] if links is not None and links.limit(1).count() else None,
    }
    return {"meta": meta, "departments": sorted(r["department"] for r in cases.select("department").distinct().collect()), "clusters": clusters}, rows
