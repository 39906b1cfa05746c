"""House taxonomy: running label centroids, classification against them, filed decisions, names carried between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CONFIDENCE_LEVELS, gated_label
from ..functions.vectors import norm, rounded, unit
from .similarity import centroid_sims

#: Examples that make a label usable, least confidence and margin, least share that names a group, similarity that carries a name, and below which it has drifted.
MIN_EXAMPLES, MIN_CONFIDENCE, MIN_MARGIN, HOUSE_SHARE, CARRY_MIN, DRIFT_BELOW = 5, 0.25, 0.02, 0.60, 0.92, 0.96


def learn(known: DataFrame | None, taught: DataFrame) -> DataFrame:
    """(label, vector_sum, n): known sums with the taught vectors (label, v) added, rounded to six places."""
    each = taught.select("label", F.posexplode("v").alias("pos", "x"), F.lit(1).cast("long").alias("n"))
    if known is not None:
        each = each.unionByName(known.select("label", F.posexplode("vector_sum").alias("pos", "x"), "n"))
    sums = each.groupBy("label", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return sums.groupBy("label").agg(
        rounded(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]), 6).alias("vector_sum"), F.first("n").alias("n")
    )


def usable(known: DataFrame, min_examples: int = MIN_EXAMPLES) -> DataFrame:
    """(c, v): unit centroids of labels with enough examples; zero vectors are left out."""
    mean = known.where(F.col("n") >= min_examples).select(F.col("label").alias("c"), F.transform("vector_sum", lambda x: x / F.col("n")).alias("v"))
    return mean.where(norm(F.col("v")) > 0).select("c", unit(F.col("v")).alias("v"))


def classify(vectors: DataFrame, known: DataFrame) -> DataFrame:
    """(id, label, confidence, margin, candidate_label, withheld_at_default); all null where no label has enough examples."""
    sims = centroid_sims(vectors, usable(known), 2)
    best, runner = F.get("sims", F.lit(0)), F.coalesce(F.get("sims", F.lit(1))["sim"], F.lit(-1.0))
    margin = best["sim"] - runner
    withheld = (best["sim"] < MIN_CONFIDENCE) | (margin < MIN_MARGIN)
    return sims.select(
        "id", F.when(~withheld, best["c"]).alias("label"), F.round(best["sim"], 4).alias("confidence"),
        F.when(best.isNotNull(), F.round(margin, 4)).alias("margin"), best["c"].alias("candidate_label"), withheld.alias("withheld_at_default"),
    )


def with_filed(predictions: DataFrame, cases: DataFrame, filed: DataFrame) -> DataFrame:
    """Predictions (id, ...), overridden where a person filed the case. cases: (id, case_key); filed: (case_key, filed_label), a row a key."""
    met = predictions.join(cases, "id").join(filed, "case_key", "left")
    human = F.col("filed_label").isNotNull()
    return met.select(
        "id", F.coalesce("filed_label", "label").alias("label"), F.when(human, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(~human, F.col("margin")).alias("margin"), F.coalesce("filed_label", "candidate_label").alias("candidate_label"),
        F.when(human, F.lit(False)).otherwise(F.col("withheld_at_default")).alias("withheld_at_default"), F.when(human, "human").otherwise("taxonomy").alias("source"),
    )


def gate(predictions: DataFrame, level: str) -> DataFrame:
    """Predictions with the label shown at a confidence level, and whether it is a guess that the default would withhold."""
    if level not in CONFIDENCE_LEVELS:
        raise ValueError(f"unknown confidence level: {level!r}")
    least, margin = CONFIDENCE_LEVELS[level]
    shown = gated_label(F.col("source"), F.col("label"), F.col("candidate_label"), F.col("confidence"), F.col("margin"), F.lit(least), F.lit(margin))
    guess = (F.coalesce("source", F.lit("")) != "human") & shown.isNotNull() & F.coalesce("withheld_at_default", F.lit(False))
    return predictions.withColumn("is_guess", guess).withColumn("label", shown)


def dominant_label(members: DataFrame, least: float = HOUSE_SHARE) -> DataFrame:
    """(cluster, label, share): the label that at least ``least`` of all members have. members: (id, cluster, label or null). Ties go to the label seen at the smallest id."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    votes = members.where("label is not null").groupBy("cluster", "label").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "first"))
    top = votes.withColumn("rank", rank).where("rank = 1").join(sizes, "cluster")
    share = F.col("n") / F.col("size")
    return top.where(share >= least).select("cluster", "label", F.round(share, 3).alias("share"))


def evaluate(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: answered, of, agreement. truth: (id, truth)."""
    met = predictions.select("id", "label").join(truth, "id")
    hit = F.avg(F.when(F.col("label").isNotNull(), (F.col("label") == F.col("truth")).cast("int")))
    return met.agg(F.count("label").alias("answered"), F.count("*").alias("of"), F.round(hit, 3).alias("agreement"))


def _name_sims(groups: DataFrame, stored: DataFrame) -> DataFrame:
    """groups (cluster, fingerprint, v) with ``sims``: (sim, (name, fingerprint)) of every stored name with a direction, best first. Groups without one are left out."""
    bank = stored.where(norm(F.col("v")) > 0).select(F.struct("name", "fingerprint").alias("c"), unit(F.col("v")).alias("v"))
    return centroid_sims(groups.where(norm(F.col("v")) > 0), bank)


def name_candidates(groups: DataFrame, stored: DataFrame) -> DataFrame:
    """(cluster, name, fingerprint_match, similarity) of every group with every stored name. groups: (cluster, fingerprint, v);
    stored: (name, fingerprint, v), a bounded list of names."""
    each = _name_sims(groups, stored).select("cluster", "fingerprint", F.explode("sims").alias("s"))
    return each.select("cluster", F.col("s.c.name").alias("name"), (F.col("s.c.fingerprint") == F.col("fingerprint")).alias("fingerprint_match"), F.round("s.sim", 4).alias("similarity"))


def restore_names(groups: DataFrame, stored: DataFrame) -> DataFrame:
    """(cluster, name, match, similarity, drift): in order of clusters, the name of the same fingerprint if untaken, whatever the centroids; else the
    most similar untaken name (ties by name) if it is similar enough, unrounded.

    Groups or names without a direction (zero vectors) match by fingerprint only. Fingerprints are met by a join; each choice depends
    on the ones before, so these are made on the driver, over a row a group with the similarities of the bounded list of names.
    """
    exact = groups.join(stored.groupBy("fingerprint").agg(F.min("name").alias("same")), "fingerprint", "left").select("cluster", "same")
    near = _name_sims(groups, stored).select("cluster", F.transform("sims", lambda s: F.struct(s["sim"].alias("sim"), s["c"]["name"].alias("name"))).alias("near"))
    taken, out = set(), []
    for r in exact.join(near, "cluster", "left").orderBy("cluster").collect():
        free = ((s["sim"], s["name"]) for s in r["near"] or () if s["name"] not in taken)
        if r["same"] is not None and r["same"] not in taken:
            name, match, sim = r["same"], "exact", 1.0
        else:
            sim, name = next(free, (None, None))
            match = "carried_over" if sim is not None and sim >= CARRY_MIN else None
            name = name if match else None
        taken |= {name} - {None}
        shown = None if sim is None else round(sim, 4)
        out.append((r["cluster"], name, match, shown, match == "carried_over" and shown < DRIFT_BELOW))
    return groups.sparkSession.createDataFrame(out, "cluster int, name string, match string, similarity double, drift boolean")
