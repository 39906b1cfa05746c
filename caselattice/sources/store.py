"""The decision store: seven Parquet tables that hold hashes, aggregates and decisions, never case text.

Every change is one commit: the parts of all its tables are written first, beside those that count, and then a file that names the
store's parts is put in place under the next number. That file appears whole or not at all, and only one writer gets a number;
another one looks at the new state and tries again. So two writers at once both count, changes of several tables come or fail
together, and readers see either state. A state also holds marks (by stream, the last batch that is in it) and the runs' tokens, so what comes a
second time is known. Parts of a table that is only added to are merged FAN_IN at a time.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import case_key, fingerprint
from ..operators import taxonomy

#: Tables and their columns.
SCHEMAS = {
    "group_names": "fingerprint string, name string, centroid array<double>, n_cases long, author string, created_at string",
    "label_centroids": "label string, vector_sum array<double>, n long, updated_at string",
    "case_labels": "case_key string, label string, author string, created_at string, seq string",
    "links": "case_a string, case_b string, kind string, author string, created_at string, seq string",
    "runs": "run_id long, created_at string, source string, k int, n_cases long, silhouette double, shuffled double, stability double, agreement double, chance double, verdict string",
    "assignments": "run_id long, case_key string, cluster_id int, label string, to_own double, to_next double, margin double, neighbours int, borderline boolean, reason string",
    "events": "kind string, detail string, author string, created_at string, seq string",
}


#: Parts of one level that are merged into one of the next; times that a commit looks at a new state.
FAN_IN, MOST_TRIES = 32, 1000


def now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")


def moment() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def state(self) -> dict:
        """The newest state: its number (0: nothing was stored), each table's parts as (folder, level), marks, tokens and the last run's id."""
        base, fs = self._fs(f"{self.root}/_log")
        names = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
        last = max((n for n in names if n.endswith(".json") and not n.startswith(".")), default=None)
        if last is None:
            return {"number": 0, "parts": {}, "marks": {}, "tokens": {}, "last_run": 0}
        stream = fs.open(self._fs(f"{self.root}/_log/{last}")[0])
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _placed(self, state: dict) -> bool:
        """Put a state under its number, in one step that fails where the number is taken: a hard link on a local file system, elsewhere a rename that doesn't overwrite."""
        made, fs = self._fs(f"{self.root}/_log/.new-{uuid.uuid4().hex}")
        out = fs.create(made)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        target = f"{self.root}/_log/{state['number']:012d}.json"
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        try:
            if fs.getUri().getScheme() == "file":
                file = lambda x: jvm.java.io.File(fs.makeQualified(x).toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(file(self._fs(target)[0]), file(made))
            else:
                rename = jvm.org.apache.hadoop.fs.Options.Rename
                how = gateway.new_array(rename, 1)
                how[0] = rename.NONE
                self._context(fs).rename(made, self._fs(target)[0], how)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(made, False)

    def _context(self, fs):
        return self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())

    def _part(self, table: str, rows: DataFrame) -> str:
        name = f"{table}/{uuid.uuid4().hex}"
        rows.select(*self.spark.createDataFrame([], SCHEMAS[table]).columns).write.parquet(f"{self.root}/{name}")
        return name

    def _levelled(self, table: str, parts: list) -> list:
        """parts, with FAN_IN of one level merged into one of the next as often as there are so many."""
        level = 0
        while level <= max(k for _, k in parts):
            own = [p for p, k in parts if k == level]
            if len(own) >= FAN_IN:
                merged = self._part(table, self._parts(table, own))
                parts = [x for x in parts if x[1] != level] + [[merged, level + 1]]
            level += 1
        return parts

    def _parts(self, table: str, names: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).parquet(*[f"{self.root}/{n}" for n in names])

    def read(self, table: str, state: dict | None = None) -> DataFrame:
        """The table in the newest state or a given one; empty where nothing was stored."""
        parts = (state or self.state())["parts"].get(table)
        return self._parts(table, [p for p, _ in parts]) if parts else self.spark.createDataFrame([], SCHEMAS[table])

    def commit(self, change: Callable[[dict], dict | None]) -> dict | None:
        """One change of the store. change(state) returns what is to hold: ``append`` and ``replace`` (rows by table), and other entries of
        the state; or None if there is nothing to do. It is asked again on the new state where another writer came first. Added rows
        are written once. Returns the new state, or None.
        """
        added: dict[str, str] = {}
        for _ in range(MOST_TRIES):
            state = self.state()
            wanted = change(state)
            if wanted is None:
                return None
            parts = dict(state["parts"])
            for table, rows in wanted.pop("append", {}).items():
                if table not in added:
                    added[table] = self._part(table, rows)
                parts[table] = self._levelled(table, [*parts.get(table, []), [added[table], 0]])
            for table, rows in wanted.pop("replace", {}).items():
                parts[table] = [[self._part(table, rows), 0]]
            new = state | wanted | {"number": state["number"] + 1, "parts": parts}
            if self._placed(new):
                return new
        raise RuntimeError("the store is changed by others all the time")

    def append(self, table: str, rows: DataFrame) -> None:
        self.commit(lambda state: {"append": {table: rows}})

    def overwrite(self, table: str, rows: DataFrame) -> None:
        """Other rows in place of the table's, whatever it holds by then. What depends on them belongs into commit()."""
        self.commit(lambda state: {"replace": {table: rows}})

    def marks(self, table: str) -> dict[str, int]:
        """By stream, the number of its last batch in the table."""
        return self.state()["marks"].get(table, {})

    def vacuum(self, hours: float = 168.0) -> int:
        """Delete parts that the newest state doesn't name and that are older than any reader or writer; how many."""
        state, gone, before = self.state(), 0, (time.time() - hours * 3600) * 1000
        for table in SCHEMAS:
            base, fs = self._fs(f"{self.root}/{table}")
            named = {p.split("/")[1] for p, _ in state["parts"].get(table, [])}
            for s in fs.listStatus(base) if fs.exists(base) else []:
                if s.getPath().getName() not in named and s.getModificationTime() < before:
                    gone += fs.delete(s.getPath(), True)
        return gone

    def rows(self, table: str, values: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(values, SCHEMAS[table])

    def event(self, kind: str, detail: dict, author: str | None = None) -> dict[str, DataFrame]:
        return {"events": self.rows("events", [(kind, json.dumps(detail, sort_keys=True), author, now(), moment())])}

    def log(self, kind: str, detail: dict, author: str | None = None) -> None:
        self.append("events", self.event(kind, detail, author)["events"])

    def _key(self, text: str) -> str:
        return self.spark.range(1).select(case_key(F.lit(text)).alias("k")).first()["k"]

    def save_name(self, keys: list[str], name: str, centroid: list[float], author: str | None = None) -> str:
        """Name a group by its fingerprint; naming it again changes name, centroid, author and time, not the number of cases."""
        fp = self.spark.createDataFrame([(keys,)], "k array<string>").select(fingerprint(F.col("k")).alias("f")).first()["f"]
        event = self.event("name", {"fingerprint": fp, "name": name}, author)

        def change(state: dict) -> dict:
            old = self.read("group_names", state)
            known = old.where(F.col("fingerprint") == fp).agg(F.min("n_cases")).first()[0]
            new = self.rows("group_names", [(fp, name, [round(x, 6) for x in centroid], len(keys) if known is None else known, author, now())])
            return {"append": event, "replace": {"group_names": old.where(F.col("fingerprint") != fp).unionByName(new).coalesce(1)}}

        self.commit(change)
        return fp

    def label_case(self, text: str, label: str, author: str | None = None) -> str:
        return self.label_cases([text], label, author)[0]

    def label_cases(self, texts: list[str], label: str, author: str | None = None) -> list[str]:
        """File cases under a label; their keys. Of a case's labels the latest counts."""
        found = self.spark.createDataFrame([(t,) for t in texts], "t string").select(case_key(F.col("t")).alias("k")).collect()
        keys, seq = [r["k"] for r in found], moment()
        filed = {"case_labels": self.rows("case_labels", [(k, label, author, now(), seq) for k in keys])} | self.event("label", {"cases": keys, "label": label}, author)
        self.commit(lambda state: {"append": filed})
        return keys

    def link_cases(self, a: str, b: str, kind: str, author: str | None = None) -> None:
        if kind not in ("same", "different"):
            raise ValueError(f"kind must be same or different, not {kind!r}")
        low, high = sorted((self._key(a), self._key(b)))
        linked = {"links": self.rows("links", [(low, high, kind, author, now(), moment())])} | self.event("link", {"a": low, "b": high, "kind": kind}, author)
        self.commit(lambda state: {"append": linked})

    def links(self) -> DataFrame:
        """The latest kind of each pair."""
        return latest(self.read("links"), ["case_a", "case_b"], "kind")

    def filed(self) -> DataFrame:
        """(case_key, filed_label): each case's latest label."""
        return latest(self.read("case_labels"), ["case_key"], "label").withColumnRenamed("label", "filed_label")

    def learn(self, taught: DataFrame, author: str | None = None, marks: dict[str, int] | None = None) -> bool:
        """Add vectors (label, v) to the running sums; only sums are kept. marks: the stream and batch that they are from. False if the store has that batch."""
        event = self.event("learn", {"labels": sorted(r["label"] for r in taught.select("label").distinct().collect())}, author)

        def change(state: dict) -> dict | None:
            own = state["marks"].get("label_centroids", {})
            if marks and all(own.get(stream, -1) >= number for stream, number in marks.items()):
                return None
            sums = taxonomy.learn(self.read("label_centroids", state).select("label", "vector_sum", "n"), taught)
            sums = sums.withColumn("updated_at", F.lit(now()))
            return {"append": event, "replace": {"label_centroids": sums}, "marks": state["marks"] | {"label_centroids": own | (marks or {})}}

        return self.commit(change) is not None

    def record_run(self, run: dict, assigned: DataFrame, token: str | None = None) -> int:
        """One row in runs, one a case in assignments (columns of that table but run_id); of cases of one key the last by the order column ``id`` stays.

        The run's number is taken first, under its token; then both tables and the log change in one commit, so runs without their
        assignments can't be. A number whose run failed stays free. The same token again gives the same number and adds nothing that is there.
        """
        token = token or uuid.uuid4().hex

        def reserve(state: dict) -> dict | None:
            if token in state["tokens"]:
                return None
            number = state["last_run"] + 1
            return {"last_run": number, "tokens": state["tokens"] | {token: {"run_id": number, "done": False}}}

        self.commit(reserve)
        run_id = self.state()["tokens"][token]["run_id"]
        names = self.spark.createDataFrame([], SCHEMAS["runs"]).columns
        full = {"run_id": run_id, "created_at": now()} | run
        last = F.row_number().over(Window.partitionBy("case_key").orderBy(F.desc("id")))
        kept = assigned.withColumn("__r", last).where("__r = 1").withColumn("run_id", F.lit(run_id).cast("long"))
        rows = {"runs": self.rows("runs", [tuple(full.get(c) for c in names)]), "assignments": kept}
        rows |= self.event("run", {"run_id": run_id, "k": run.get("k"), "verdict": run.get("verdict")})

        def record(state: dict) -> dict | None:
            if state["tokens"][token]["done"]:
                return None
            return {"append": dict(rows), "tokens": state["tokens"] | {token: {"run_id": run_id, "done": True}}}

        self.commit(record)
        return run_id


def latest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of each key's last row by (created_at, seq)."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct("created_at", "seq")).alias(value))


def training_set(labels: DataFrame, min_per_label: int = 5) -> DataFrame:
    """(label, keys): labels with enough cases, keys sorted. labels: distinct (case_key, label)."""
    return labels.groupBy("label").agg(F.array_sort(F.collect_set("case_key")).alias("keys")).where(F.size("keys") >= min_per_label)


def run_history(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("run_id")).limit(limit)


def case_history(assignments: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """A case's assignments in all runs, newest first."""
    return assignments.where(F.col("case_key") == key).join(runs.select("run_id", "created_at", "k"), "run_id").orderBy(F.desc("run_id"))


def best_k(runs: DataFrame, min_runs: int = 2) -> DataFrame:
    """One row, the k of the best mean stability, then agreement; none until min_runs different k are recorded."""
    by = runs.where("stability is not null").groupBy("k").agg(F.count("*").alias("runs"), F.avg("stability").alias("stability"), F.avg("agreement").alias("agreement"), F.avg("chance").alias("chance"))
    enough = by.agg(F.count("*").alias("n")).where(F.col("n") >= min_runs)
    best = by.orderBy(F.desc(F.round("stability", 9)), F.desc(F.round(F.coalesce("agreement", F.lit(0.0)), 9)), "k").limit(1)
    return best.crossJoin(enough).select("k", "runs", F.round("stability", 4).alias("stability"), F.round("agreement", 4).alias("agreement"), F.round("chance", 4).alias("chance"))


def summary(store: Store) -> dict:
    counts = {t: store.read(t).count() for t in ("group_names", "case_labels", "links", "runs", "events")}
    known = store.read("label_centroids").select("label", "n").collect()
    return counts | {"taxonomy": {r["label"]: r["n"] for r in known}, "ready": sorted(r["label"] for r in known if r["n"] >= taxonomy.MIN_EXAMPLES)}
