"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from braidline.operators import stats
from braidline.plans import ORACLES, QUERIES, statistics


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf_dir, oracle, same_rows):
    same_rows(QUERIES[name](spark, sf_dir), oracle, ORACLES[name])


def test_queries_without_sql_give_rows(spark, sf_dir):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, sf_dir).count() > 0, name


def test_paired_bootstrap_takes_all_samples(spark, sf_dir):
    pairs = statistics._pairs(lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")).where("a is not null and b is not null")
    want = stats.paired_bootstrap(pairs.selectExpr("domain", "b - a AS delta"), "domain", "delta", samples=10_000)
    assert sorted(QUERIES["paired_bootstrap"](spark, sf_dir).collect()) == sorted(want.collect())


def test_logistic_is_the_limit_of_descent(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2)) * [1, 40] + [3, 7]
    y = rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 3 + 0.02 * x[:, 1])))
    rows = spark.createDataFrame([(float(a), float(b), bool(v)) for (a, b), v in zip(x, y, strict=True)], "a double, b double, y boolean")
    got = stats.logistic(rows, ["a", "b"], "y")
    z = (x - x.mean(0)) / x.std(0)
    w, c = np.zeros(2), float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(20_000):
        off = 1 / (1 + np.exp(-(z @ w + c))) - y
        c -= 0.05 * off.mean()
        w -= 0.05 * ((off[:, None] * z).mean(0) + 0.01 * w)
    assert np.allclose([got["bias"], got["a"], got["b"]], [c, *w], atol=1e-6)
    assert set(stats.logistic(rows.where("false"), ["a"], "y")) == {"bias", "a"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
