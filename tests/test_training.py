"""Kernel, strata, updates and training; tests named after the survey's ledger keep its decisions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.functions import rates
from factorloom.functions.initialisers import custom, pseudo_random, unseeded
from factorloom.functions.updates import SGD, Mock, RegularizedSGD
from factorloom.functions.vectors import block_of, dot
from factorloom.operators import parameter_server as ps
from factorloom.operators.predict import empirical_risk, objective, predictions
from factorloom.operators.state import fanned_out, looked_up, ratings_by_item, side, tagged, unblocked
from factorloom.operators.train import DSGD, Model, offline_dsgd
from factorloom.plans.kernel import Diverged, levels, sweep
from factorloom.plans.strata import blocks_for, check_rank, descend, start
from factorloom.sources import store
from factorloom.sources.ratings import from_csv, from_memory

GEN = np.random.default_rng(1)
ROWS = [(int(u), int(i), float(r)) for u, i, r in zip(GEN.integers(-9, 9, 150), GEN.integers(0, 12, 150), GEN.random(150), strict=True)]


def plain(rows, order, init, eta, known=None):
    """Sequential SGD in Python."""
    u, v = dict((known or {}).get("user", {})), dict((known or {}).get("item", {}))
    for n in order:
        a, b, r = rows[n]
        p, q = u.setdefault(a, init(a)), v.setdefault(b, init(b))
        e = eta * (r - float(p @ q))
        u[a], v[b] = p + e * q, q + e * p
    return {("user", k): x for k, x in u.items()} | {("item", k): x for k, x in v.items()}


def start_of(i):
    return np.array([math.sin(i + k) for k in range(3)])


INIT = custom(lambda i: start_of(i).tolist())


def as_dict(df):
    return {(r["kind"], r["id"]): np.array(r["vector"]) for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        np.testing.assert_allclose(a[k], b[k], atol=1e-12)


def test_levels_hold_the_order_of_shared_ids():
    u, i = np.array([1, 1, 2, 2, 3]), np.array([1, 2, 1, 2, 9])
    assert levels(u, i).tolist() == [1, 2, 2, 3, 1]


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_strata_are_sequential_sgd(spark, blocks):
    got = as_dict(offline_dsgd(from_memory(spark, ROWS), INIT, SGD(0.05), blocks=blocks, sweeps=2))
    stratum = lambda n: (abs(ROWS[n][0]) % blocks - abs(ROWS[n][1]) % blocks) % blocks
    order = sorted(range(len(ROWS)), key=lambda n: (stratum(n), abs(ROWS[n][0]) % blocks, n))
    close(got, plain(ROWS, order * 2, start_of, 0.05))


def test_partitioning_does_not_matter(spark):
    r = from_memory(spark, ROWS)
    close(as_dict(offline_dsgd(r.repartition(7), INIT, SGD(0.05), blocks=2)), as_dict(offline_dsgd(r.coalesce(1), INIT, SGD(0.05), blocks=2)))


def test_updates_and_untouched_are_all(spark):
    known = spark.createDataFrame([("user", 500, [1.0, 2.0, 3.0]), ("item", 3, [1.0, 0.0, 0.0])], "kind string, id int, vector array<double>")
    r = from_memory(spark, ROWS)
    every, some = as_dict(offline_dsgd(r, INIT, SGD(0.05), known=known)), as_dict(offline_dsgd(r, INIT, SGD(0.05), known=known, updates_only=True))
    assert every.keys() - some.keys() == {("user", 500)} and every["user", 500].tolist() == [1.0, 2.0, 3.0]
    close(every, plain(ROWS, range(len(ROWS)), start_of, 0.05, {"user": {500: np.array([1.0, 2, 3])}, "item": {3: np.array([1.0, 0, 0])}}))


def test_user_block_expression(spark):
    r = from_memory(spark, ROWS)
    shift = lambda c: F.pmod(c + 1, F.lit(2)).cast("int")
    got = as_dict(offline_dsgd(r, INIT, SGD(0.05), blocks=2, block=shift))
    order = sorted(range(len(ROWS)), key=lambda n: (((ROWS[n][0] + 1) % 2 - (ROWS[n][1] + 1) % 2) % 2, (ROWS[n][0] + 1) % 2, n))
    close(got, plain(ROWS, order, start_of, 0.05))


def test_empty_ratings(spark):
    assert offline_dsgd(from_memory(spark, []), INIT, SGD(0.1)).count() == 0


def test_mock_updates():
    u, v = np.ones((1, 2)), np.full((1, 2), 3.0)
    assert Mock().next_factors(None, u, v) == (u, v) and Mock().delta(None, u, v) == (u, v)
    a, b = RegularizedSGD(0.1, 0.0).next_factors(np.array([2.0]), u, v)
    c, d = SGD(0.1).next_factors(np.array([2.0]), u, v)
    np.testing.assert_allclose([a, b], [c, d])


def test_rates():
    assert rates.default(1.0, 4, 0) == 0.5 and rates.constant(0.3, 9, 1) == 0.3
    assert rates.bottou(2)(9, 1, 0.5) == 1 and rates.inverse_scaling(2)(1, 2, 0) == 0.25
    assert rates.xu(1)(1, 1, 1) == 0.5


def test_d5_unseeded_vectors_are_drawn_once(spark):
    r = from_memory(spark, [(1, 1, 0.5)])
    log_and_state = descend(r, start(r, unseeded(3)), SGD(0.0))
    assert as_dict(log_and_state[0].select("kind", "id", "vector"))["user", 1].shape == (3,)
    rows = log_and_state[0].select("vector")
    assert rows.collect() == rows.collect()


def test_d6_d7_blocks_of_every_id(spark):
    ids = [-(2**31), -5, 0, 5, 2**31 - 1]
    got = [r.b for r in spark.createDataFrame([(i,) for i in ids], "id int").select(block_of(F.col("id"), 7).alias("b")).collect()]
    assert got == [abs(i) % 7 for i in ids]


def test_d11_blocks_are_even_and_d12_sides_can_differ(spark):
    df = spark.range(1, 2001).select(F.col("id").cast("int").alias("id"))
    sizes = [r["count"] for r in df.groupBy(block_of(F.col("id"), 8)).count().collect()]
    assert sizes == [250] * 8
    one, two = df.limit(1).select(pseudo_random(4)(F.col("id")).alias("a"), pseudo_random(4, side=99)(F.col("id")).alias("b")).first()
    assert one != two and one[:2] == [0.7308781907032909, 0.41008081149220166]


def test_d13_schedule():
    assert [rates.sweep_of(s, 2) for s in range(4)] == [1, 1, 2, 2]
    assert [rates.sweep_of(s, 2, compat=True) for s in range(4)] == [1, 2, 2, 3]


def test_d14_defaults():
    d = DSGD()
    assert (d.rank, d.penalty, d.sweeps, d.blocks, d.seed, d.eta) == (10, 1.0, 10, None, 0, 0.001)
    with pytest.raises(ValueError):
        DSGD(rank=0)


def test_d15_d16_risk_counts_a_copy_once_and_tells_what_it_covers(spark):
    users = spark.createDataFrame([(1, [1.0, 2.0])], "id int, vector array<double>")
    items = spark.createDataFrame([(1, [3.0, 1.0])], "id int, vector array<double>")
    r = from_memory(spark, [(1, 1, 4.0), (1, 1, 4.0), (2, 1, 9.0)])
    got = empirical_risk(r, users, items, 0.1).first()
    assert got["known"] == 2 and got["risk"] == pytest.approx(2 * (1 + 0.1 * 15))
    assert objective(r, users, items, 0.1).first()[0] == pytest.approx(2 + 0.1 * 15)
    assert empirical_risk(from_memory(spark, [(7, 7, 1.0)]), users, items).count() == 0
    assert predictions(r, users, items).collect() == [(1, 1, 5.0)] * 2


def test_d17_unfitted_model(spark):
    with pytest.raises(RuntimeError, match="fitted"):
        Model(None).predict(from_memory(spark, ROWS))


def test_d33_divergence_is_an_error(spark):
    rows = [(u % 3, i % 3, 500.0) for u in range(6) for i in range(6)]
    with pytest.raises(Exception, match="diverged"):
        offline_dsgd(from_memory(spark, rows), pseudo_random(4), SGD(0.5), sweeps=3)
    with pytest.raises(Diverged):
        sweep(np.array([0] * 40), np.array([0] * 40), np.full(40, 1e9), np.ones((1, 2)), np.ones((1, 2)), SGD(9.0).next_factors)


def test_fit_and_predict(spark):
    r = from_memory(spark, ROWS)
    model = DSGD(rank=3, penalty=0.0, sweeps=4, blocks=2, eta=0.1).fit(r)
    start_risk = empirical_risk(r, *(side(start(r, pseudo_random(3)).select("kind", "id", "vector"), k) for k in ("user", "item")), 0.0).first()["risk"]
    assert model.empirical_risk(r).first()["risk"] < start_risk
    assert model.predict(r).count() == len(ROWS)


def test_rank_mismatch_is_an_error(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vector array<double>")
    with pytest.raises(ValueError, match="lengths"):
        check_rank(df)
    assert df.select(dot(F.col("vector"), F.array(F.lit(1.0), F.lit(1.0)), 2)).collect()[0][0] is None


def test_small_operators(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0])], "id int, vector array<double>")
    both = tagged(v, v)
    assert side(both, "item").collect() == v.collect() and fanned_out(both, 3).rdd.getNumPartitions() == 3
    blocks = spark.createDataFrame([([4, 5], [[1.0], [2.0]])], "ids array<int>, vectors array<array<double>>")
    assert sorted(map(tuple, unblocked(blocks).collect())) == [(0, 4, [1.0]), (1, 5, [2.0])]
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    assert dict(looked_up(ids, v, lambda c: F.array(F.lit(9.0))).collect()) == {1: [1.0], 2: [9.0]}
    from_memory(spark, ROWS[:5]).write.csv(str(tmp_path / "r"))
    assert sorted(from_csv(spark, str(tmp_path / "r")).collect()) == sorted(from_memory(spark, ROWS[:5]).collect())


def test_nulls_and_repeated_known_vectors(spark):
    """Ratings with a null take no part; of several known vectors the smallest counts."""
    rows = [(1, 2, 0.5, 0), (None, 2, 0.1, 1), (1, None, 0.1, 2), (1, 2, None, 3), (3, 2, 0.9, 4), (3, 2, 0.9, 4)]
    r = spark.createDataFrame(rows, "user int, item int, rating double, seq long")
    known = spark.createDataFrame([("user", 1, [0.5, 0.1]), ("user", 1, [0.2, 0.3]), ("user", None, [1.0, 1.0]), ("user", 9, [1.0, 2.0]), ("user", 9, None)], "kind string, id int, vector array<double>")
    one = spark.createDataFrame([("user", 1, [0.2, 0.3]), ("user", 9, [1.0, 2.0])], "kind string, id int, vector array<double>")
    init = pseudo_random(2)
    want = as_dict(offline_dsgd(r.dropna(), init, SGD(0.1), known=one))
    assert want.keys() == {("user", 1), ("user", 3), ("user", 9), ("item", 2)}
    for blocks in (1, 2):
        close(as_dict(offline_dsgd(r, init, SGD(0.1), known=known, blocks=blocks)), as_dict(offline_dsgd(r.dropna(), init, SGD(0.1), known=one, blocks=blocks)))
    for f in (lambda x: DSGD(rank=2).fit(x).factors, lambda x: ps.offline(x, rank=2), lambda x: ps.offline(x, rank=2, batch=1), lambda x: ps.stale_items(x, rank=2)):
        close(as_dict(f(r)), as_dict(f(r.dropna())))
    made = spark.createDataFrame([(1,), (None,)], "id int").select(custom(lambda i: [i])(F.col("id")).alias("v")).collect()
    assert [x.v for x in made] == [[1.0], None]


def test_blocks_grow_with_the_ratings(spark):
    assert [blocks_for(spark.range(n), 10) for n in (0, 1, 10, 11, 40, 41, 90, 91)] == [1, 1, 1, 2, 2, 3, 3, 4]


def test_arrays_by_item_have_bounded_rows(spark):
    r = from_memory(spark, [(n, 0 if n % 3 else n, 1.0) for n in range(300)])
    made = ratings_by_item(r, 20).collect()
    assert sorted((x.user, x.item) for row in made for x in row.ratings) == sorted((n, 0 if n % 3 else n) for n in range(300))
    assert len([row for row in made if row.item == 0]) > 5 and all(len(row.ratings) < 60 and row.ratings == sorted(row.ratings) for row in made)


def test_the_shared_folder(spark, monkeypatch):
    class Fake:
        master, at = "spark://x", None

        @property
        def sparkContext(self):
            return self

        conf = property(lambda self: self)
        get = lambda self, name, other: other
        getCheckpointDir = lambda self: self.at

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.shared_dir(Fake())
    fake = Fake()
    fake.at = "hdfs://a/b"
    assert store.shared_dir(fake) == "hdfs://a/b"
