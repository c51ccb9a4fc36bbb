import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import detect, dispatch


@pytest.fixture
def windowed(make_windows):
    rng = np.random.default_rng(1)
    large = make_windows({"M-02": [rng.normal(size=60), rng.normal(4, 1, size=60)], "M-06": [rng.normal(size=60), rng.normal(size=60)]}, "large")
    return large.unionByName(make_windows({"M-02": [[1.0, 2.0, 3.0]]}, "small"))


def fails_in_its_job(windowed):
    return dispatch.registry(["M-02", "M-06"])["D-01"](windowed).withColumn("kind", F.raise_error(F.lit("worker trouble")).cast("string"))


def fails_while_planned(windowed, **options):
    raise KeyError("no such column")


def test_one_failing_detector_leaves_the_others(windowed):
    detectors = dispatch.registry(["M-02", "M-06"])
    want = sorted(map(tuple, detect.run_detectors(windowed.where("repo_id = 'large'"), ["M-02", "M-06"], ("D-01", "D-03")).collect()), key=str)
    for broken, message in ((fails_in_its_job, "worker trouble"), (fails_while_planned, "KeyError")):
        events, status = dispatch.dispatch(windowed, detectors | {"D-02": broken}, enabled=["D-01", "D-02", "D-03", "D-77"])
        rows = {(r.repo_id, r.detector): r for r in status.collect()}
        assert len(rows) == status.count() == 8
        assert sorted(map(tuple, events.collect()), key=str) == want
        assert rows["large", "D-02"].status == "error" and message in rows["large", "D-02"].reason
        assert rows["large", "D-01"].status == "executed" and rows["large", "D-01"].events == sum(r[1] == "D-01" for r in want) > 0
        assert rows["small", "D-01"].status == "skipped" and rows["small", "D-01"].reason == "rows_short=7, windows_short=1"
        assert rows["small", "D-77"].reason == rows["large", "D-77"].reason == "not registered"


def test_an_option_that_does_not_exist_is_an_error_row(windowed):
    status = dispatch.dispatch(windowed, dispatch.registry(["M-02"]), config={"D-03": {"nonsense": 1}}, enabled=["D-03"])[1]
    row = status.where("repo_id = 'large'").first()
    assert row.status == "error" and row.reason.startswith("TypeError")


def test_no_repositories(windowed):
    events, status = dispatch.dispatch(windowed.where("false"), dispatch.registry(["M-02"]))
    assert events.count() == status.count() == 0
