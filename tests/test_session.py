"""Session settings and scratch folders."""

import os

from logstream import session


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class Session:
    def __init__(self, **conf):
        self.conf = Conf({"spark.master": "yarn", **conf})


def test_shuffles_start_wide_on_a_cluster_only(spark):
    assert session.WIDE_PARTITIONS >= 4096
    assert spark.conf.get(session.WIDE, None) is None
    assert session.is_local(spark) and not session.is_local(Session())
    assert not session.is_local(Session(**{"spark.master": "local-cluster[2,1,512]"}))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    import pytest

    with pytest.raises(ValueError):
        session.scratch(Session(), "x")
    path = session.scratch(Session(**{"spark.checkpoint.dir": "hdfs:///shared/"}), "x")
    session._made.remove(path)
    assert path.startswith("hdfs:///shared/logstream/x-")


def test_scratch_is_cleared(spark):
    frame = session.stored(spark.range(3), "kept")
    path = session._made[-1]
    assert frame.count() == 3 and os.path.isdir(path) and session.folders(spark, path)
    session.clear_scratch(spark)
    assert not os.path.exists(path) and not session._made
