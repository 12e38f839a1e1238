from types import SimpleNamespace

import pytest

from prudence.llm.scratch import shared_folder, stored


def session(master, **conf):
    """What shared_folder reads of a session."""
    settings = dict(conf)
    kept = SimpleNamespace(get=lambda key, default=None: settings.get(key, default), set=settings.__setitem__)
    return SimpleNamespace(conf=kept, sparkContext=SimpleNamespace(master=master, getConf=lambda: kept))


def test_named_folder_is_taken_on_any_master():
    for master in ("local[8]", "spark://host:7077", "local-cluster[3,2,1024]"):
        assert shared_folder(session(master, **{"spark.checkpoint.dir": "/shared/x/"})) == "/shared/x"


def test_cluster_without_a_shared_folder_raises():
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))


def test_one_machine_gets_one_folder_a_session():
    spark = session("local[*]")
    assert shared_folder(spark) == shared_folder(spark)


def test_stored_keeps_empty_tables_and_odd_columns(spark):
    df = spark.createDataFrame([], "doc_id long, `a.b` string, text string")
    back = stored(df, "empty")
    assert back.schema == df.schema and back.count() == 0
