import threading

import pytest

from wardflow.plans.together import run_together


def test_jobs_overlap_in_their_own_pools(spark):
    meeting = threading.Barrier(3, timeout=60)  # broken unless all three run at once

    def job(n):
        def work():
            meeting.wait()
            return spark.sparkContext.getLocalProperty("spark.scheduler.pool"), spark.range(n).count()
        return work

    got = run_together(spark, {f"job{n}": job(n) for n in (1, 2, 3)})
    assert got == {f"job{n}": (f"job{n}", n) for n in (1, 2, 3)}


def test_a_failure_is_raised_after_the_others_end(spark):
    done = []

    def fails():
        raise KeyError("no model")

    with pytest.raises(KeyError, match="no model"):
        run_together(spark, {"bad": fails, "good": lambda: done.append(spark.range(5).count())})
    assert done == [5] and run_together(spark, {}) == {}
