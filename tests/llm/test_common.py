"""What the corpus operators share."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from tidemark.llm import common


def session(configured, checkpoints, master):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoints, setCheckpointDir=made.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: configured), sparkContext=context), made


def test_the_shared_folder_is_never_local_to_a_machine_of_a_cluster():
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(session(None, None, master)[0])
        assert common.shared_dir(session("hdfs:///shared/", None, master)[0]) == "hdfs:///shared"
        assert common.shared_dir(session(None, "hdfs:///x", master)[0]) == "hdfs:///x"
    alone, made = session(None, None, "local[4]")
    assert common.shared_dir(alone) == made[0].rstrip("/")
