"""The shared folder and what is written to it."""

from pathlib import Path

import pytest

from tidefolio import session


def test_release_deletes_what_was_written(spark):
    session.release(spark)
    kept = session.cut_lineage(spark.range(5))
    by = session.cut_lineage(spark.range(6).selectExpr("id", "id % 3 AS k"), ["k"])
    assert kept.count() == 5 and by.where("k = 1").count() == 2
    folders = [Path(p.removeprefix("file:")) for p in session._WRITTEN[spark.sparkContext.applicationId]]
    assert len(folders) == 2 and all(f.is_dir() for f in folders)
    assert session.release(spark) == 2
    assert not any(f.exists() for f in folders) and session.release(spark) == 0


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "yarn", "spark://host:7077"])
def test_only_one_process_may_use_its_own_folder(master):
    class Context:
        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Spark:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    Spark.sparkContext.master = master
    with pytest.raises(RuntimeError, match="shared"):
        session.shared_dir(Spark())
