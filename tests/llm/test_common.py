from types import SimpleNamespace

import pytest
from foliospark.llm import common


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda name, default=None: folder)
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_a_cluster_must_name_the_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session("spark://host:7077"))
    assert common.shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_dir(session("local[2]")).startswith("file:///")
