from types import SimpleNamespace

import pytest

from threadloom import session


def fake(named, master):
    conf = SimpleNamespace(get=lambda key, default=None: named or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="x"))


def test_the_cluster_names_the_shared_folder():
    assert session.shared_root(fake("/shared/ck", "yarn")) == "/shared/ck"
    assert session.scratch_path(fake("/shared/ck/", "yarn"), "t").startswith("/shared/ck/threadloom/x/t-")


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(fake(None, "spark://host:7077"))


def test_scratch_paths_are_never_reused(spark):
    assert session.scratch_path(spark, "t") != session.scratch_path(spark, "t")
    assert session.shared_root(spark) == session.shared_root(spark)


def test_counts_of_a_written_table(spark):
    from pyspark.sql import functions as F

    written, seen = session.materialise_counting(spark.range(7), "t", n=F.count("*"), top=F.max("id"))
    assert seen == {"n": 7, "top": 6} and written.count() == 7
