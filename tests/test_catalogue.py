"""Every core query runs; those with SQL give the same rows."""

import pytest

import oracle
from sievemark import plans


def aligned(spark, frame):
    """Label texts have six digits and documents whole pixels, so no corner moves further; one row an image whose boxes all came through."""
    rows = frame.collect()
    good = [r for r in rows if r.yolo_error != float("inf")]
    return len(rows) == len({r.image_id for r in rows}) > 50 and len(good) > 20 and all(r.yolo_error < 0.01 for r in good) and all(r.voc_error <= 0.5 for r in rows)


def intervals(spark, frame):
    """Eight intervals that hold what the scores themselves give, or come near it."""
    found = {r.metric: (r.lower_95, r.upper_95) for r in frame.collect()}
    whole = plans.QUERIES["confusion_metrics"](spark, oracle.DATA).first()
    names = ["auroc", "auprc", "sensitivity", "specificity", "balanced_accuracy", "f1", "ece_10_bin", "brier"]
    slack = {"ece_10_bin": 0.05}  # resampling biases it upwards
    return set(found) == set(names) and all(found[m][0] - slack.get(m, 0) <= whole[m] <= found[m][1] and found[m][0] < found[m][1] for m in names)


#: Of queries that SQL can't state: what their rows must be.
CHECKED = {"cross_format_box_error": aligned, "bootstrap_ci": intervals}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    frame = plans.QUERIES[name](spark, oracle.DATA)
    if name in plans.SQL:
        oracle.same(frame, plans.SQL[name])
    else:
        assert CHECKED[name](spark, frame)


def test_sql_names_are_queries():
    assert set(plans.SQL) | set(CHECKED) == set(plans.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
