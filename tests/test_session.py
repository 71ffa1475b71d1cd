"""Where intermediate tables go, and that they go away."""

import os
from types import SimpleNamespace

import pytest

from logweave import session
from logweave.session import Scratch, shared_dir


def fake(master="local[4]", conf=None, context=None, checkpoint=None):
    get = lambda values: SimpleNamespace(get=lambda k, d=None: (values or {}).get(k, d))
    sc = SimpleNamespace(
        master=master, applicationId=f"app-{master}", getConf=lambda: get(context), getCheckpointDir=lambda: checkpoint
    )
    return SimpleNamespace(conf=get(conf), sparkContext=sc)


def test_the_named_folder_comes_first():
    key = "spark.checkpoint.dir"
    assert shared_dir(fake(conf={key: "/a"}, context={key: "/b"}, checkpoint="/c")) == "/a"
    assert shared_dir(fake(context={key: "/b"}, checkpoint="/c")) == "/b"
    assert shared_dir(fake("yarn", checkpoint="/c")) == "/c"


def test_only_a_local_session_gets_a_temporary_folder():
    own = fake("local[2]")
    first = shared_dir(own)
    assert os.path.isdir(first) and shared_dir(own) == first
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(fake(master))
    session._LOCAL_DIRS.pop(own.sparkContext.applicationId)
    os.rmdir(first)


def test_scratch_tables_are_deleted(spark):
    scratch = Scratch(spark, "test")
    assert scratch.save(spark.range(5), "a").count() == 5
    scratch.save(spark.range(3), "b")
    root = scratch.root.removeprefix("file:")
    scratch.drop("a")
    assert not os.path.exists(f"{root}/a") and os.path.exists(f"{root}/b")
    scratch.close()
    assert not os.path.exists(root)
