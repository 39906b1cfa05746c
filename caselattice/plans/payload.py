"""The payload as a folder: points as ordered JSON lines written by Spark's tasks, and a manifest that commits them.

``manifest.json`` holds meta, departments, groups and the name of the folder of points. It is put in place by one rename after
the points are written, so readers see the old payload or the new one. Points are as many part files as Spark chose; their names
follow the points' order, so they can be streamed into one document without being held. Nothing but the groups' rows and one
buffer passes through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a point, and the markers around a payload in a page.
POINT = (
    "id string, x double, y double, z double, tx double, ty double, tz double, cluster int, department string, severity int, date string, summary string, "
    "nearest array<struct<i: bigint, sim: double>>, house string, house_confidence double, house_margin double, house_candidate string, house_withheld boolean, house_source string, "
    "why struct<to_own: double, to_next: double, next_group: int, margin: double, neighbours_agreeing: int, borderline: boolean, reason: string>"
)
START, END = "<!-- MM_PAYLOAD_START -->", "<!-- MM_PAYLOAD_END -->"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_payload(points: DataFrame, head: dict, path: str, order: str = "n") -> Payload:
    """Points (POINT's fields and the order column) and the head {meta, departments, clusters} as the folder's new payload.

    An interrupted write leaves the payload that was there. The points before the last ones are deleted with the next
    write; readers of the last ones are not disturbed. Equal order values keep no order among them; no points give an empty list.
    """
    spark, path = points.sparkSession, path.rstrip("/")
    old = _manifest(spark, path)
    folder = f"points-{uuid.uuid4().hex}"
    fields = [F.col(c) for c in points.columns if c != order]
    lines = points.repartitionByRange(order).sortWithinPartitions(order).select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.text(f"{path}/{folder}")
    rows = spark.read.text(f"{path}/{folder}").count()
    new, fs = _fs(spark, f"{path}/.manifest-{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(bytearray(json.dumps(head | {"points": {"folder": folder, "rows": rows, "before": old["points"]["folder"] if old else None}}, ensure_ascii=False).encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(new, _fs(spark, f"{path}/manifest.json")[0], how)
    if old and old["points"]["before"]:
        fs.delete(_fs(spark, f"{path}/{old['points']['before']}")[0], True)
    return Payload(spark, path)


def _manifest(spark: SparkSession, path: str) -> dict | None:
    p, fs = _fs(spark, f"{path}/manifest.json")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


class Points:
    """The points of a payload: countable, iterable one by one in their order, and a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str, rows: int):
        self.spark, self.folder, self.rows = spark, folder, rows

    def __len__(self) -> int:
        return self.rows

    def __iter__(self) -> Iterator[dict]:
        return (json.loads(line) for line in self.lines())

    def frame(self) -> DataFrame:
        """All points with POINT's schema. Filters on fields outside of structs and arrays are pushed to the scan."""
        return self.spark.read.schema(POINT).json(self.folder)

    def lines(self) -> Iterator[str]:
        """The JSON of all points in order; the driver holds a partition of one part file at a time."""
        base, fs = _fs(self.spark, self.folder)
        for name in sorted(s.getPath().getName() for s in fs.listStatus(base) if s.getPath().getName().startswith("part-")):
            stream = self.spark._jvm.java.io.BufferedReader(self.spark._jvm.java.io.InputStreamReader(fs.open(_fs(self.spark, f"{self.folder}/{name}")[0]), "UTF-8"), 1 << 20)
            try:
                while (line := stream.readLine()) is not None:
                    yield line
            finally:
                stream.close()


class Payload(Mapping):
    """A written payload: meta, departments and clusters from its manifest, points from its folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        found = _manifest(spark, self.path)
        if found is None:
            raise ValueError(f"no payload in {path}")
        at = found["points"]
        self.head = found | {"points": Points(spark, f"{self.path}/{at['folder']}", at["rows"])}

    def __getitem__(self, key):
        return self.head[key]

    def __iter__(self):
        return iter(self.head)

    def __len__(self) -> int:
        return len(self.head)

    def point(self, case_id: str) -> dict:
        """The first point of a case."""
        found = self["points"].frame().where(F.col("id") == case_id).limit(1).select(_json()).first()
        if found is None:
            raise ValueError(f"no case {case_id}")
        return json.loads(found[0])

    def members(self, cluster: int) -> DataFrame:
        """The points of a group."""
        return self["points"].frame().where(F.col("cluster") == cluster)

    def text(self) -> Iterator[str]:
        """One JSON document {meta, departments, clusters, points}, in pieces."""
        head = json.dumps({k: v for k, v in self.head.items() if k != "points"}, ensure_ascii=False)
        yield head[:-1] + (", " if len(self.head) > 1 else "") + '"points": ['
        for i, line in enumerate(self["points"].lines()):
            yield (", " if i else "") + line
        yield "]}"


def _json():
    return F.to_json(F.struct("*"), {"ignoreNullFields": "false"})


def injected(pieces: Iterator[str], template: str) -> Iterator[str] | None:
    """The template with the first marked block holding the pieces, whose ``</`` can't end a script; None without markers."""
    a = template.find(START)
    b = template.find(END, a)
    if a < 0 or b < 0:
        return None

    def run() -> Iterator[str]:
        yield template[: a + len(START)]
        for piece in pieces:
            yield piece.replace("</", "<\\/")
        yield template[b:]

    return run()
