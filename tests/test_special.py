import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffspark.functions import special
from diffspark.functions.keyed import keyed_normal, keyed_uniform


def values(spark, expression, **columns):
    names = list(columns)
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    return [r[0] for r in df.coalesce(1).select(expression).collect()]


def test_t_golden(spark):
    got = values(spark, special.t_two_sided("t", "df"), t=[2.0, 2.0, 10.0, 0.0, -2.0], df=[10.0, 7.5, 6.0, 3.0, 10.0])
    assert got == pytest.approx([0.0733880, 0.0828970, 5.79198e-5, 1.0, 0.0733880], rel=2e-6)


def test_t_limits(spark):
    got = values(
        spark, special.t_two_sided("t", "df"), t=[1.96, None, 1.96, 1e3], df=[math.inf, 3.0, 1e6, 500.0]
    )
    assert got[0] == pytest.approx(math.erfc(1.96 / math.sqrt(2)))
    assert got[1] is None
    assert got[2] == pytest.approx(got[0], rel=1e-5)
    assert 0 <= got[3] < 1e-100


def test_t_one_degree_is_cauchy(spark):
    t = [0.1, 0.5, 1.0, 7.0, 300.0]
    want = [1 - 2 * math.atan(x) / math.pi for x in t]
    assert values(spark, special.t_two_sided("t", "df"), t=t, df=[1.0] * 5) == pytest.approx(want, rel=1e-11)


def test_normal(spark):
    got = values(spark, special.normal_two_sided("z"), z=[0.0, 1.0, -3.0, None])
    assert got == pytest.approx([1.0, math.erfc(1 / math.sqrt(2)), math.erfc(3 / math.sqrt(2)), None])


def test_digamma_trigamma(spark):
    x = [0.5, 1.0, 2.5, 30.0]
    euler = 0.5772156649015329
    psi = values(spark, special.digamma(F.col("x")), x=x)
    tri = values(spark, special.trigamma(F.col("x")), x=x)
    assert psi[0] == pytest.approx(-euler - 2 * math.log(2), abs=1e-13)
    assert psi[1] == pytest.approx(-euler, abs=1e-13)
    assert tri[0] == pytest.approx(math.pi**2 / 2, abs=1e-12)
    assert tri[1] == pytest.approx(math.pi**2 / 6, abs=1e-12)
    up = values(spark, special.digamma(F.col("x") + 1) - special.digamma(F.col("x")), x=x)
    assert up == pytest.approx([1 / v for v in x], rel=1e-11)


def test_trigamma_inverse(spark):
    x = [0.3, 1.0, 3.0, 40.0, 1e4]
    goal = values(spark, special.trigamma(F.col("x")), x=x)
    back = values(spark, special.trigamma_inverse("v"), v=[*goal, -1.0, None])
    assert back[:-2] == pytest.approx(x, rel=1e-8)
    assert back[-2:] == [None, None]


def test_binomial_tail_golden():
    smallest = {n: special.smallest_significant(n) for n in (5, 10, 20, 100, 1000)}
    assert smallest == {5: 5, 10: 9, 20: 15, 100: 59, 1000: 527}
    assert special.smallest_significant(4) is None


def test_binomial_udf_agrees_with_table(spark):
    for n in (5, 20, 1000):
        tail = special.binomial_tail(n)
        got = values(spark, special.binomial_upper("k", "n"), k=[float(k) for k in range(n + 1)], n=[float(n)] * (n + 1))
        assert got == pytest.approx(tail, rel=1e-9, abs=1e-300)


def test_keyed_draws(spark):
    df = spark.range(20000).select(
        keyed_uniform(7, [F.col("id")], "a").alias("u"), keyed_normal(7, [F.col("id")]).alias("z")
    )
    pdf = df.toPandas()
    assert 0 < pdf.u.min() and pdf.u.max() < 1
    assert abs(pdf.u.mean() - 0.5) < 0.01
    assert abs(pdf.z.mean()) < 0.03 and abs(pdf.z.std() - 1) < 0.03
    again = df.repartition(7).toPandas()
    assert np.allclose(np.sort(again.z), np.sort(pdf.z), rtol=0, atol=0)


def test_array_tail_agrees_with_math():
    x = np.concatenate([np.linspace(0, 6, 601), [10.0, 20.0, 27.0]])
    want = np.array([math.erfc(v) for v in x])
    assert np.allclose(special._erfc(x), want, rtol=1e-12, atol=0)


def test_fraction_steps_until_it_settles():
    n = 1e7  # symmetric: one half, plus half the probability of the middle
    got = float(special.beta_inc(n, n + 1, 0.5, 0.5))
    assert got == pytest.approx(0.5 + 0.5 / math.sqrt(math.pi * n), rel=1e-7)
