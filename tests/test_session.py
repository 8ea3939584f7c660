"""The work folder of stored tables."""

from types import SimpleNamespace

import pytest

from cyclelake.session import shared_folder, stored


def fake(master, folder=None):
    kept = {"spark.checkpoint.dir": folder} if folder else {}
    conf = SimpleNamespace(get=lambda k, d=None: kept.get(k, d), set=kept.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_folder(master):
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_folder(fake(master))
    assert shared_folder(fake(master, "hdfs://x/work")) == "hdfs://x/work"


def test_local_mode_makes_one_folder():
    session = fake("local[4]")
    assert shared_folder(session) == shared_folder(session)


def test_stored_rows_are_the_same(spark):
    assert stored(spark.range(5)).count() == 5
