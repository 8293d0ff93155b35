"""Online training, folds, generators and the parameter server."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.functions.initialisers import pseudo_random
from factorloom.functions.updates import SGD
from factorloom.operators import parameter_server as ps
from factorloom.operators.train import offline_dsgd
from factorloom.sources.ratings import discrete, from_memory, generated, stream_files, stream_rate
from factorloom.sources.store import VersionedState
from factorloom.streaming.online import OfflineOnline, Online, due, fold, to_console, traced

from .test_training import ROWS, as_dict, close


def write_batches(spark, path, n=3):
    r = from_memory(spark, ROWS)
    for k in range(n):
        r.where(F.floor(F.col("seq") / 50) == k).coalesce(1).write.mode("append").parquet(path)


def test_online_over_a_file_stream(spark, tmp_path):
    write_batches(spark, str(tmp_path / "in"))
    model = Online(spark, rank=3, eta=0.05, path=str(tmp_path / "model"))
    query = model.start(stream_files(spark, str(tmp_path / "in")), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert query.exception() is None
    close(as_dict(model.factors(2)), as_dict(offline_dsgd(from_memory(spark, ROWS), pseudo_random(3), SGD(0.05))))
    close(as_dict(model.updates(0)), as_dict(offline_dsgd(from_memory(spark, ROWS[:50]), pseudo_random(3), SGD(0.05))))


def test_d2_d30_a_batch_that_runs_again_changes_nothing(spark):
    model = Online(spark, rank=3, eta=0.05, retrain_every=2, retrain_sweeps=1)
    r = from_memory(spark, ROWS)
    part = lambda k: r.where(F.floor(F.col("seq") / 50) == k)
    for k in (0, 0, 1, 1, 2):
        model.process(part(k), k)
    close(as_dict(model.factors(2)), as_dict(offline_dsgd(r, pseudo_random(3), SGD(0.05))))
    assert model.history.upto(1).count() == 100


def test_online_with_als(spark):
    model = Online(spark, rank=2, retrain_every=1, retrain="ALS", retrain_sweeps=2)
    model.process(from_memory(spark, [(abs(u), i, r) for u, i, r in ROWS]), 0)
    assert model.factors(0).count() == len({abs(u) for u, _, _ in ROWS}) + len({i for _, i, _ in ROWS})


def test_d1_periods(spark):
    assert [n for n in range(7) if due(n, 3)] == [2, 5]
    assert not any(due(n, p) for n in range(5) for p in (None, -1))
    with pytest.raises(ValueError):
        Online(spark, retrain_every=0)
    with pytest.raises(ValueError):
        Online(spark, retrain="other")


def test_fold_sizes(spark):
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "x int")
    process, state = fold(spark, frame([-1, -2]), lambda s, b: s.unionByName(b))
    sizes = []
    for n, first in enumerate((10, 20, 30)):
        process(frame(range(first, first + 4)), n)
        sizes.append(process(frame(range(first, first + 4)), n).count())  # again, as after a failure
    assert sizes == [6, 10, 14] and state.read(2).count() == 14


def test_state_versions(spark):
    state = VersionedState(spark)
    assert state.read(5) is None
    state.write(spark.range(3), 0)
    assert state.read(1).count() == 3


def test_d8_generators_keep_their_seed_and_d9_their_range(spark):
    seeds = spark.range(3000).select(F.col("id").alias("seq"))
    a = generated(seeds, 50, 20, skew=3.0)
    assert a.collect() == generated(seeds.repartition(5), 50, 20, skew=3.0).orderBy("seq").collect()
    lo, hi, n = a.agg(F.min("user"), F.max("user"), F.count("*")).first()
    assert lo == 0 and hi < 50 and n == 3000
    assert a.where("user < 10").count() > 0.4 * n > 2 * generated(seeds, 50, 20).where("user < 10").count() * 0.9
    x = spark.range(1).select(discrete(F.lit(1 - np.exp(-1.0)), 10, 1.0, compat=True), discrete(F.lit(1 - np.exp(-1.0)), 10, 1.0)).first()
    assert x[0] in (9, 10) and x[1] in (9, None)


def test_rate_stream_has_the_schema(spark):
    df = stream_rate(spark, 10, 5, 5)
    assert df.isStreaming and df.columns == ["user", "item", "rating", "seq"]


def test_push_before_pull_is_an_error(spark):
    v = lambda rows: spark.createDataFrame(rows, "id int, vector array<double>")
    with pytest.raises(Exception, match="before the first pull"):
        ps.pushed(v([(1, [1.0])]), v([(2, [1.0])])).collect()
    got = dict(ps.pushed(v([(1, [1.0, 2.0]), (3, [0.0, 0.0])]), v([(1, [1.0, 1.0]), (1, [2.0, 0.0])])).collect())
    assert got == {1: [4.0, 3.0], 3: [0.0, 0.0]}


def test_ps_batches_lie_between_sequential_and_gradient(spark):
    r = from_memory(spark, ROWS[:40])
    init = pseudo_random(3)
    sequential, _one = as_dict(ps.offline(r, rank=3, eta=0.05, batch=1)), None
    close(sequential, as_dict(offline_dsgd(r, init, SGD(0.05))))
    all_at_once = as_dict(ps.offline(r, rank=3, eta=0.05))
    halves = as_dict(ps.offline(r, rank=3, eta=0.05, batch=20))
    assert all_at_once.keys() == halves.keys() == sequential.keys()
    assert any(not np.allclose(halves[k], all_at_once[k]) for k in halves)


def test_d22_a_rating_of_minus_one_is_a_rating(spark):
    r = from_memory(spark, [(0, 0, -1.0)])
    got = as_dict(offline_dsgd(r, pseudo_random(1), SGD(1.0)))
    p = 0.730967787376657
    assert got["user", 0][0] == pytest.approx(p + (-1 - p * p) * p)


def test_d23_seeded_order_takes_effect(spark):
    r = from_memory(spark, ROWS[:30])
    runs = [as_dict(ps.offline(r, rank=2, eta=0.1, batch=1, seed=s)) for s in (None, 1, 1, 2)]
    close(runs[1], runs[2])
    assert any(not np.allclose(runs[0][k], runs[1][k]) for k in runs[0])
    assert any(not np.allclose(runs[3][k], runs[1][k]) for k in runs[0])


def test_d25_d26_d31_trigger_starts_both_sides_anew(spark):
    server = OfflineOnline(spark, rank=3, eta=0.05, retrain_sweeps=2)
    first, second = from_memory(spark, ROWS[:30]), from_memory(spark, ROWS[:60]).where("seq >= 30")
    changed = as_dict(server.process(first, 0))
    close(changed, as_dict(offline_dsgd(first, pseudo_random(3), SGD(0.05))))
    want = as_dict(offline_dsgd(from_memory(spark, ROWS[:60]), pseudo_random(3), SGD(0.05), sweeps=2))
    for _ in range(2):  # again, as after a failure
        server.process(second, 1, True)
        close(as_dict(server.factors(1)), want)
    assert server.history.upto(1).count() == 60


def test_triggers_come_as_a_stream(spark, tmp_path):
    """Three files of ratings, the second with a trigger beside it; the query stops and goes on."""
    r = from_memory(spark, ROWS[:90])
    server = OfflineOnline(spark, rank=3, eta=0.05, retrain_sweeps=2, path=str(tmp_path / "model"))
    signs = spark.createDataFrame([(1,)], "at int")
    for n in range(3):
        rows = r.where(F.floor(F.col("seq") / 30) == n)
        server.with_triggers(rows, signs.where(F.lit(n == 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("user int, item int, rating double, seq long, trigger boolean").parquet(str(tmp_path / "in"))
        query = server.start(stream, str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        assert query.exception() is None
    trained = offline_dsgd(from_memory(spark, ROWS[:60]), pseudo_random(3), SGD(0.05), sweeps=2)
    close(as_dict(server.factors(2)), as_dict(offline_dsgd(r.where("seq >= 60"), pseudo_random(3), SGD(0.05), known=trained)))


def test_a_row_per_rating_from_a_stream(spark, tmp_path):
    write_batches(spark, str(tmp_path / "in"))
    model = Online(spark, rank=3, eta=0.05, path=str(tmp_path / "model"), keep_trace=True)
    model.start(stream_files(spark, str(tmp_path / "in")), str(tmp_path / "checkpoint")).awaitTermination(120)
    log, _ = traced(from_memory(spark, ROWS), rank=3, eta=0.05)
    want = {x.seq: (x.user, x.item, x.user_vector, x.item_vector) for x in log.collect()}
    got = {x.seq: (x.user, x.item, x.user_vector, x.item_vector) for n in range(3) for x in model.trace(n).collect()}
    assert got.keys() == want.keys() and len(got) == len(ROWS)
    for seq, (user, item, u, v) in want.items():
        assert got[seq][:2] == (user, item) and np.allclose(got[seq][2], u) and np.allclose(got[seq][3], v)


def test_stale_items_take_users_in_turn(spark):
    r = from_memory(spark, [(1, 5, 1.0), (1, 6, 0.5), (2, 5, 0.2), (1, 5, 0.7)])
    init, eta = pseudo_random(2), 0.1
    first = {x.id: np.array(x.v) for x in spark.createDataFrame([(i,) for i in (1, 2, 5, 6)], "id int").select("id", init(F.col("id")).alias("v")).collect()}
    u, v = {k: first[k].copy() for k in (1, 2)}, {k: first[k].copy() for k in (5, 6)}
    for user, item, rating in ((1, 5, 1.0), (2, 5, 0.2), (1, 5, 0.7), (1, 6, 0.5)):
        e = eta * (rating - u[user] @ first[item])
        v[item] += e * u[user]
        u[user] = u[user] + e * first[item]
    want = {("user", k): x for k, x in u.items()} | {("item", k): x for k, x in v.items()}
    for blocks in (1, 2):
        close(as_dict(ps.stale_items(r, rank=2, eta=eta, blocks=blocks)), want)


def test_console_and_a_rate_that_is_kept(spark, tmp_path):
    write_batches(spark, str(tmp_path / "in"), 1)
    query = to_console(stream_files(spark, str(tmp_path / "in")), str(tmp_path / "a"))
    query.awaitTermination(60)
    assert query.exception() is None and sum(p["numInputRows"] for p in query.recentProgress) == 50
    query = stream_rate(spark, 40, 5, 5).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "b")).trigger(processingTime="1 second").start()
    try:
        query.awaitTermination(9)
        rows = [p["numInputRows"] for p in query.recentProgress]
        assert sum(rows) > 100 and sum(rows) % 40 == 0 and sum(rows) <= 40 * 10
    finally:
        query.stop()


def test_compaction_changes_nothing(spark):
    r = from_memory(spark, ROWS)
    models = [Online(spark, rank=3, eta=0.05, compact_every=n) for n in (1, 2, 50)]
    for k in range(5):
        for model in models:
            model.process(r.where(F.floor(F.col("seq") / 30) == k), k)
    want = as_dict(offline_dsgd(r, pseudo_random(3), SGD(0.05)))
    for model in models:
        close(as_dict(model.factors(4)), want)
