"""Every factorization query against SQL on the smallest tables."""

import pytest

from factorloom import queries as q

from .conftest import same

SQL = q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small, name):
    same(q.queries()[name](spark, small), small, SQL[name])


def test_als_beats_the_mean_and_repeats(spark, small):
    from pyspark.sql import functions as F

    from factorloom.operators.predict import predictions
    from factorloom.operators.state import side
    from factorloom.operators.train import als
    from factorloom.sources.ratings import from_memory

    r = from_memory(spark, [(u, i, (u % 5 + 1) * (i % 4 + 1) / 5) for u in range(20) for i in range(12)])
    factors = als(r, 2, 5, seed=1, blocks=2).cache()
    made = predictions(r, side(factors, "user"), side(factors, "item")).join(r, ["user", "item"])
    error, spread = made.agg(F.sqrt(F.avg((F.col("rating") - F.col("prediction")) ** 2)), F.stddev_pop("rating")).first()
    assert error < spread / 2
    assert sorted(map(str, factors.collect())) == sorted(map(str, als(r, 2, 5, seed=1, blocks=2).collect()))
    ids = {(x["kind"], x["id"]) for x in als(q.event_ratings(spark, small), 4, 2).collect()}
    assert ids == {("user", x.user) for x in q.event_ratings(spark, small).select("user").distinct().collect()} | {("item", i) for i in range(5)}


def test_the_package_stands_without_its_llm_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['factorloom.llm'] = None; import factorloom.queries, factorloom.streaming.online, factorloom.operators.parameter_server; assert not [m for m in sys.modules if m.startswith('factorloom.llm.')]"
    subprocess.run([sys.executable, "-c", code], check=True)
