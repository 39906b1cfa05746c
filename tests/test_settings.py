"""Settings of a session that several threads share."""

import threading

import pytest

from caselattice.functions import tables


def test_threads_put_back_what_was_there(spark):
    key, before = tables.CLEAN_UP, spark.conf.get(tables.CLEAN_UP)
    inside, leave, seen = threading.Barrier(2), threading.Event(), []

    def first():
        with tables.one_use(spark):
            inside.wait()
            leave.wait()
        seen.append(spark.conf.get(key))

    t = threading.Thread(target=first)
    t.start()
    inside.wait()
    with tables.one_use(spark, {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}):
        leave.set()
        t.join()
        assert spark.conf.get(key) == "true" and seen == ["true"]  # still held by the second
        with pytest.raises(RuntimeError), tables.one_use(spark, {"spark.sql.legacy.bucketedTableScan.outputOrdering": "false"}):
            pass
    assert spark.conf.get(key) == before and spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false" and not tables._held
