from types import SimpleNamespace

import pytest

from quirespark import session


def test_a_cluster_has_to_name_the_shared_folder():
    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)


def test_stored_tables_are_read_back_and_discarded(spark):
    t = session.stored(spark.range(5).selectExpr("id", "id % 2 = 0 AS even"), "five")
    assert t.count() == 5 and t.schema["even"].dataType.simpleString() == "boolean"
    session.discard(t, spark.range(1))
    with pytest.raises(Exception, match="."):
        spark.read.parquet(t._stored_at).count()
