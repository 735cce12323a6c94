"""HOTA wherever tasks and batches of rows end."""

import numpy as np
import pytest

from kinetable.operators import metrics


@pytest.fixture
def batches_of_seven(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_task_with_one_frame(spark):
    df = spark.createDataFrame([("v", 0, i, j, 1.0 if i == j else 0.1) for i in range(3) for j in range(3)], "v string, f long, t long, s long, sim double")
    r = metrics.hota(df, "v", "f", "t", "s", "sim").first()
    assert abs(r["hota"] - 1) < 1e-9 and abs(r["loc_a"] - 1) < 1e-9
    one = metrics.hota(df.where("t = 0 and s = 0"), "v", "f", "t", "s", "sim").first()
    assert abs(one["hota"] - 1) < 1e-9


def test_batches_within_one_frame_give_the_same(spark, request):
    rng = np.random.default_rng(5)
    rows = [(f"v{f % 2}", f, i, j, float(rng.random())) for f in range(9) for i in range(1 + f % 5) for j in range(1 + f * 3 % 7)]
    df = spark.createDataFrame(rows, "v string, f long, t long, s long, sim double").coalesce(1)
    want = {r["v"]: r for r in metrics.hota(df, "v", "f", "t", "s", "sim").collect()}
    request.getfixturevalue("batches_of_seven")
    got = {r["v"]: r for r in metrics.hota(df, "v", "f", "t", "s", "sim").collect()}
    assert set(got) == set(want) == {"v0", "v1"}
    for v, r in want.items():
        assert [got[v][c] for c in r.asDict() if c != "v"] == pytest.approx([r[c] for c in r.asDict() if c != "v"], abs=1e-12)
