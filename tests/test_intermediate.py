"""Where intermediate results go, and that nothing of them stays."""

import os

import pytest

from goldweave.operators import intermediate


def test_they_lie_in_the_shared_folder_and_go(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    one, two = (intermediate.materialise(spark.range(3), "kept") for _ in range(2))
    mine = os.path.join(folder, f"goldweave-{spark.sparkContext.applicationId}")
    assert one._goldweave_path.startswith(mine) and one.count() == 3
    intermediate.release(one)
    assert not os.path.exists(one._goldweave_path) and os.path.exists(two._goldweave_path) and two.count() == 3


def test_everything_of_an_application_goes_at_the_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(intermediate, "_FOLDERS", {})
    monkeypatch.setattr(intermediate, "shared_dir", lambda spark: str(tmp_path))
    intermediate.materialise(spark.range(3), "kept")
    assert os.listdir(tmp_path)
    intermediate.clean()
    assert not os.listdir(tmp_path) and not intermediate._FOLDERS


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Nothing:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = property(lambda self: self)

        def sc(self):
            return self

        def getCheckpointDir(self):
            return Nothing()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        intermediate.shared_dir(Session())
