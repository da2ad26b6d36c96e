import pytest
from pyspark.sql import functions as F

from targetry.functions import requests
from targetry.operators import stats


def test_change_addresses(spark):
    sha = "0123456789abcdef" * 2 + "01234567"
    good = f"github://host.example:8080/org/team/repo/pull/12/{sha}"
    bad = [good.upper(), good.replace("12", "012"), good + "?q", good[:-1], good.replace("/org", "//org"), good.replace("github", "http"), good.replace("/team/repo", ""), None]
    got = [r.c for r in spark.createDataFrame([(u,) for u in [good, *bad]], "u string").select(requests.change(F.col("u")).alias("c")).collect()]
    assert tuple(got[0]) == ("host.example:8080", "org/team", "repo", "12", sha) and got[1:] == [None] * len(bad)


def test_descriptions():
    one = requests.BuildDescription("r", "s")
    requests.check_pair(one, requests.BuildDescription("r", "t", strategy="NATIVE"))
    for make in (lambda: requests.BuildDescription("", "s"), lambda: requests.BuildDescription("r", ""), lambda: requests.BuildDescription("r", "s", strategy="x"), lambda: requests.check_pair(one, requests.BuildDescription("q", "s")), lambda: requests.resolve_repository("x", {})):
        with pytest.raises(ValueError):
            make()
    assert requests.resolve_repository("r", {"r": {"a": 1}}) == {"a": 1}


def test_stats(spark):
    rows = spark.createDataFrame([(i, i % 5) for i in range(50)], "i int, v int")
    got = {r.i: r.before for r in stats.prefix_sums(rows, "v", "i").collect()}
    assert got == {i: sum(k % 5 for k in range(i)) for i in range(50)}
    assert [tuple(r) for r in stats.histogram(rows, "v", [0, 2]).collect()] == [(0.0, 10), (2.0, 30), (float("inf"), 50)]
