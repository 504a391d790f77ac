"""The tables that cut lineage: where they lie, and that they go again."""

import os

import pytest
from pyspark.sql import functions as F

from gatelight.sources import shared


class Session:
    def __init__(self, master):
        self.sparkContext = type("C", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://https://host"])
def test_no_folder_of_one_machine_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.folder(Session(master))
    assert shared.folder(Session("local[8]")).startswith("file://")


def test_tables_on_the_way_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "folder", lambda _: f"file://{tmp_path}")
    out = shared.only(lambda: shared.keep(shared.keep(spark.range(5)).withColumn("x", F.col("id") * 2)).where("id > 1"))
    assert len([x for x in os.listdir(tmp_path) if x.startswith("gatelight-")]) == 1
    assert sorted(r.x for r in out.collect()) == [4, 6, 8]
    shared.drop(len(shared._written) - 1)
    assert not [x for x in os.listdir(tmp_path) if x.startswith("gatelight-")]
