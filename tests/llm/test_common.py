from types import SimpleNamespace

import pytest

from longspan.llm import common


def session(master, folder=None, checkpoint=None):
    held = SimpleNamespace(isDefined=lambda: checkpoint is not None, get=lambda: checkpoint)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: held)))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: folder), sparkContext=context)


def test_scratch_folders_are_shared():
    """From the setting, else the context's folder; a local one only in local mode, never on a cluster."""
    assert common.scratch(session("spark://x:1", "hdfs://a/b/")).startswith("hdfs://a/b/longspan-")
    assert common.scratch(session("yarn", None, "s3://c")).startswith("s3://c/longspan-")
    assert common.scratch(session("local[4]")).startswith("file:///")
    for master in ("yarn", "spark://x:1", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.scratch(session(master))


def test_tables_are_deleted_when_done(spark):
    kept = common.written(spark.range(3))
    with common.tidied(spark) as mine:
        inner = common.written(spark.range(4))
        out = common.written(inner.where("id > 1"))
        mine.append(out)
    assert kept.count() == 3 and out.count() == 2
    with pytest.raises(Exception):
        spark.read.schema(inner.schema).parquet(inner._longspan_path).count()
    common.discard(kept)
    with pytest.raises(Exception):
        spark.read.schema(kept.schema).parquet(kept._longspan_path).count()
