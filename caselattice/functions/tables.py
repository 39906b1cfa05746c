"""Tables in the folder that driver and executors share, and joins with sides of a counted size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set: a folder of our own in local mode (tests), on a cluster an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where and sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc._jsc.sc().getCheckpointDir().get()
    if not where:
        if not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="caselattice-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_lock, _held = threading.Lock(), {}


@contextmanager
def one_use(spark: SparkSession, settings: dict[str, str] | None = None) -> Iterator[None]:
    """Plans begun inside leave no shuffle files behind: Spark removes them as each ends. settings: others that hold meanwhile.

    They are the session's, so threads that share one share them: the first to enter sets a value, the last to leave puts back
    what was there before. Threads that want different values of a setting need sessions of their own.
    """
    settings = {CLEAN_UP: "true"} | (settings or {})
    session = spark._jsparkSession.hashCode()
    with _lock:
        for k, v in settings.items():
            if (session, k) in _held and _held[session, k][2] != v:
                raise RuntimeError(f"{k} is held at {_held[session, k][2]} by another plan of this session")
        for k, v in settings.items():
            _held.setdefault((session, k), [0, spark.conf.get(k), v])[0] += 1
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _lock:
            for k in settings:
                entry = _held[session, k]
                entry[0] -= 1
                if not entry[0]:
                    spark.conf.set(k, entry[1])
                    del _held[session, k]


def written(df: DataFrame, name: str, *partition_by: str, compression: str = "zstd", settings: dict[str, str] | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read back: short lineage that outlives any executor. settings: as of one_use()."""
    path, schema = table_path(df.sparkSession, name), df.schema
    with one_use(df.sparkSession, settings):
        writer = df.write.option("compression", compression)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    back = df.sparkSession.read.schema(schema).parquet(path)
    back._table_path = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows, and bytes of them, that a join may send to every task at once, after they were counted.
MOST_BROADCAST, MOST_BROADCAST_BYTES = 100_000, 16 << 20


def few(rows: DataFrame) -> bool:
    """Whether rows may be broadcast. At most MOST_BROADCAST + 1 of them are read."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(16) if "<" not in t else F.octet_length(F.to_json(F.struct(c))) for c, t in rows.dtypes]
    size = reduce(lambda a, b: a + b, wide, F.lit(8)).cast("long")
    found = rows.limit(MOST_BROADCAST + 1).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    return found["n"] <= MOST_BROADCAST and (found["bytes"] or 0) <= MOST_BROADCAST_BYTES


def met(rows: DataFrame, side: DataFrame, on, how: str = "inner") -> DataFrame:
    """rows joined with a side: broadcast where it is counted small, else merged, where Spark splits large keys."""
    return rows.join(F.broadcast(side) if few(side) else side.hint("merge"), on, how)
