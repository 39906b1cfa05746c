"""The refinement loop: load a register, look at its groups, name them or file cases, and run again.

What a reader decides goes to the store; the next run takes it from there.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import numbered
from ..functions.scalars import case_key
from ..operators import geometry
from ..sources.store import Store
from ..sources.tabular import DELIMITED, SHEETS, load_register
from .compile import compile_to, embed
from .payload import injected

MOST_BYTES, LEAST_K, MOST_K, LONGEST_NAME = 32 << 20, 2, 12, 60


class Workbench:
    def __init__(self, spark: SparkSession, store: Store, k: int = 5, seed: int = 42, rounds: int = 12, model=None, namer=None):
        self.spark, self.store, self.seed, self.rounds, self.model, self.namer = spark, store, seed, rounds, model, namer
        self.k, self.source, self.register, self.payload = min(MOST_K, max(LEAST_K, k)), "", None, None

    def ingest(self, path: str, overrides: dict[str, str] | None = None, most_bytes: int = MOST_BYTES) -> dict:
        """Load a register of at most most_bytes and run."""
        suffix = PurePosixPath(path).suffix.lower()
        if suffix not in DELIMITED | SHEETS:
            raise ValueError(f"{suffix or path} is not a supported kind of file")
        size = self.spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
        if not size or size > most_bytes:
            raise ValueError(f"{path} has {size} bytes; 1 to {most_bytes} are taken")
        self.register, self.source = load_register(self.spark, path, overrides).cache(), PurePosixPath(path).name
        return self.rebuild()

    def rebuild(self) -> dict:
        if self.register is None:
            raise ValueError("no register is loaded")
        self.payload = compile_to(f"{self.store.root}/payload", self.spark, self.register, self.k, self.seed, self.store, self.rounds, self.model, self.namer, self.source)
        return self.payload

    def set_clusters(self, k: int) -> dict:
        self.k = min(MOST_K, max(LEAST_K, int(k)))
        return self.rebuild()

    def point(self, case_id: str) -> dict:
        """A case of the last run, read from the written payload."""
        return self.payload.point(case_id)

    def members(self, cluster: int) -> DataFrame:
        """A group's points, read from the written payload."""
        return self.payload.members(cluster)

    def name_group(self, cluster: int, name: str, author: str | None = None) -> dict:
        """Name a group; its core, the cases nearest to its centre, teaches the name."""
        name, own = _name(name), self.members(cluster).select("id", "summary", "x", "y", "z")
        if own.isEmpty():
            raise ValueError(f"no group {cluster}")
        centre = next(c["centroid"] for c in self.payload["clusters"] if c["id"] == cluster)
        keys = [r["k"] for r in own.select(case_key(F.col("summary")).alias("k")).collect()]
        self.store.save_name(keys, name, centre, author)
        points = numbered(own.orderBy("id"), "row").select(F.col("row").alias("id"), F.lit(cluster).alias("label"), "x", "y", "z", F.col("id").alias("case_id"))
        core = geometry.core_members(points.drop("case_id")).join(points.select("id", "case_id"), "id")
        self._teach([r["case_id"] for r in core.select("case_id").collect()], name, author)
        return self.rebuild()

    def file_cases(self, case_ids: list[str], label: str, author: str | None = None) -> dict:
        """File cases under a label, each once however often it is listed, and run once."""
        ids = sorted(set(case_ids))
        if not ids:
            raise ValueError("no cases")
        for i in ids:
            self.point(i)
        self._teach(ids, _name(label), author)
        return self.rebuild()

    def _teach(self, case_ids: list[str], label: str, author: str | None) -> None:
        chosen = self.register.join(self.spark.createDataFrame([(i,) for i in case_ids], "case_id string"), "case_id", "left_semi")
        self.store.label_cases([r["case_summary"] for r in chosen.select("case_summary").collect()], label, author)
        vectors = embed(chosen.withColumnRenamed("case_id", "id"), self.model)
        self.store.learn(vectors.select(F.lit(label).alias("label"), "v"), author)

    def filtered(self, **filters) -> DataFrame:
        from .compile import register_filter

        return register_filter(self.register, **filters)

    def write(self, json_path: str, template: str | None = None, page: str | None = None) -> bool:
        """The payload as a file; also injected into a copy of an HTML template. False if that has no markers."""
        with open(json_path, "w", encoding="utf-8") as f:
            f.writelines(self.payload.text())
        if template is None:
            return True
        with open(template, encoding="utf-8") as f:
            made = injected(self.payload.text(), f.read())
        if made is None:
            return False
        with open(page, "w", encoding="utf-8") as f:
            f.writelines(made)
        return True


def _name(name: str) -> str:
    name = " ".join(str(name).split())
    if not 1 <= len(name) <= LONGEST_NAME:
        raise ValueError(f"a name has 1 to {LONGEST_NAME} characters")
    return name
