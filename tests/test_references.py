"""Which published column stands for a metric."""

import pytest
from pyspark.sql import functions as F

from wattlens.operators import references as rf
from wattlens.plans import jobs


def values(spark, rows, schema, kind, metric=""):
    d = spark.createDataFrame(rows, schema)
    return [None if r[0] is None else round(r[0], 9) for r in d.select(rf.reference_value(d, kind, metric)).collect()]


@pytest.mark.parametrize("schema,rows,kind,metric,want", [
    ("uFOR double, `Forced Outage-Rate ` string", [(None, "7.5"), (None, "x"), (None, "2")], "forced", "uFOR", [7.5, None, 2.0]),  # first column empty, second percent
    ("FOR double", [(0.1,), (0.2,)], "forced", "uFOR", [10.0, 20.0]),
    ("uEUOR double, uFOR double", [(0.5, 0.1)], "forced", "uEFOR", [50.0]),
    ("uFOR double, wUOF double", [(0.1, 0.3)], "forced", "uUOR", [30.0]),
    ("uTOF double, uFOR double", [(30.0, 10.0), (5.0, 10.0)], "planned", "uPOR", [20.0, 0.0]),
    ("uETOF double, uTOF double, uFOR double", [(40.0, 30.0, 10.0)], "planned", "uESOR", [30.0]),
    ("POD double", [(36.5,)], "planned", "uSOR", [10.0]),
    ("planned_outage_days double, uFOR double", [(73.0, 0.05), (None, 0.05), (None, None)], "total", "uTOF", [25.0, 5.0, None]),
    ("other double", [(1.0,)], "forced", "", [None]),
])
def test_chain(spark, schema, rows, kind, metric, want):
    assert values(spark, rows, schema, kind, metric) == want


def test_percent_by_the_95th_percentile_and_kinds(spark):
    d = spark.createDataFrame([(0.5,)] * 99 + [(70.0,)] + [(float("inf"),)] * 3 + [(None,)], "FOR double")
    assert d.select(rf.percent(d, "FOR")).first()[0] == 50.0  # one odd value does not make a column of fractions a percentage
    with pytest.raises(ValueError):
        rf.steps("other")
    assert rf.default_metrics("ERAA 2023") == ["uFOR", "uEFOR", "uUOR", "uEUOR"] and len(rf.default_metrics("TYNDP")) == 10


def test_metric_rows_keep_common_pairs_or_our_own(spark):
    rows = [("DE", "Gas", "pub", 5.0, None), ("FR", "Gas", "pub", 7.0, None), ("DE", "Gas", "own", 0.04, 48.0), ("IT", "Gas", "own", 0.05, 24.0), ("FR", None, "own", 0.01, 1.0)]
    t = spark.createDataFrame(rows, "country string, t string, source string, uFOR double, wRR_so_h double")
    got = sorted(tuple(r) for r in rf.metric_rows(t, "t", "pub", "own", ["uFOR"]).collect())
    assert got == [("DE", "Gas", "own", "uFOR", 4.0), ("DE", "Gas", "pub", "uFOR", 5.0)]
    none = rf.metric_rows(t, "t", "pub", "own", ["uPOR"])  # no such column on either side
    assert none.count() == 0
    planned = t.withColumn("uPOR", F.when(F.col("source") == "own", 0.1))
    assert sorted(tuple(r) for r in rf.metric_rows(planned, "t", "pub", "own", ["uPOR"]).collect()) == [("DE", "Gas", "own", "uPOR", 10.0)]
    out = jobs.compare_metrics(t, "t", "pub", "own", 5, ["uFOR"])
    assert [tuple(r) for r in out["pairs_uFOR"].select("country", "pub", "own", "diff").collect()] == [("DE", 5.0, 4.0, -1.0)]
