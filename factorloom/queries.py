"""The factorization queries by name, each over its whole tables, and SQL that says the same.

Doubles are rounded to six places on both sides: sums differ in their last bits by order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.initialisers import pseudo_random
from .functions.updates import SGD
from .functions.vectors import block_of, dot, first_block, lcg_uniforms, next_block, rating_block, shifted, squared_norm
from .operators import parameter_server as ps
from .operators.predict import empirical_risk as risk_of
from .operators.predict import objective as objective_of
from .operators.predict import predictions
from .operators.state import last_values, merged, rating_blocks, ratings_by_item, summed
from .operators.train import DSGD, als, als_residuals, offline_dsgd
from .sources.ratings import batches, from_events, from_orders, generated
from .sources.store import stored
from .streaming.online import OfflineOnline, Online, fold, fold2, traced

RANK, ETA = 4, 0.01
INIT = pseudo_random(RANK)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_ratings(spark, sf_dir):
    return from_orders(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def event_ratings(spark, sf_dir):
    return from_events(table(spark, sf_dir, "events"))


def spread(vector: str = "vector", names: str = "f") -> list:
    return [F.round(F.get(F.col(vector), F.lit(i)), 6).alias(f"{names}{i}") for i in range(RANK)]


def rows_of(factors: DataFrame) -> DataFrame:
    return factors.select("kind", "id", *spread())


def sides_of(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    one = lambda c: ratings.select(F.col(c).alias("id")).distinct().select("id", INIT(F.col("id")).alias("vector"))
    return one("user"), one("item")


# Sources and relational operators


def ratings_from_orders(spark, sf_dir):
    return order_ratings(spark, sf_dir).select("user", "item", F.round("rating", 6).alias("rating"))


def rating_occurrence_counts(spark, sf_dir):
    r = order_ratings(spark, sf_dir)
    one = lambda c: r.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("omega")).select(F.lit(c).alias("kind"), "id", "omega")
    return one("user").unionByName(one("item"))


def factor_init_lcg(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("user").alias("kind"), F.col("c_custkey").cast("int").alias("id"))
    p = table(spark, sf_dir, "part").select(F.lit("item").alias("kind"), F.col("p_partkey").cast("int").alias("id"))
    made = c.unionByName(p).withColumn("vector", INIT(F.col("id")))
    return made.select("kind", "id", *[F.get("vector", F.lit(i)).alias(f"f{i}") for i in range(RANK)])


def block_assignment(spark, sf_dir):
    c = F.col("c_custkey").cast("int")
    b = block_of(c, 8)
    return table(spark, sf_dir, "customer").select(c.alias("id"), b.alias("block"), block_of(-c, 8).alias("negative_block"), shifted(b, 3, 8).alias("shifted"), first_block(b, 8).cast("int").alias("first"), next_block(first_block(b, 8), 8, True).alias("next_user"), next_block(first_block(b, 8), 8, False).alias("next_item"))


def block_strata(spark, sf_dir):
    u, i = block_of(F.col("user"), 4), block_of(F.col("item"), 4)
    behind, ahead = F.pmod(u - i, F.lit(4)).cast("int"), F.pmod(i - u, F.lit(4)).cast("int")
    r = order_ratings(spark, sf_dir)
    return r.groupBy(rating_block(u, i, 4).cast("int").alias("rating_block"), behind.alias("behind"), ahead.alias("ahead")).agg(F.count("*").alias("n"))


def rating_block_arrays(spark, sf_dir):
    made = rating_blocks(event_ratings(spark, sf_dir), 3)
    return _told(made, "rating_block", 4)


def item_arrays(spark, sf_dir):
    return _told(ratings_by_item(event_ratings(spark, sf_dir), 500), "item", 4)


def _told(arrays, key, places):
    """Of arrays of ratings, a row per key: how many, the first in order, and the sum."""
    total = F.aggregate("ratings", F.lit(0.0), lambda a, x: a + x["rating"])
    per = arrays.groupBy(key).agg(F.sum(F.size("ratings")).cast("long").alias("n"), F.min(F.get("ratings", F.lit(0))).alias("first"), F.round(F.sum(total), places).alias("total"))
    return per.select(key, "n", F.col("first.user").alias("first_user"), F.col("first.item").alias("first_item"), "total")


def state_merge(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("id"), F.col("c_acctbal").alias("x"))
    new = table(spark, sf_dir, "events").groupBy((F.col("user_id") * 2).cast("int").alias("id")).agg(F.max("value").alias("x"))
    return merged(old, new, ["id"], "x")


def vector_sum_push(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return summed(e).select("id", F.posexplode("vector").alias("place", "x")).select("id", "place", F.round("x", 6).alias("total"))


def last_value_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return last_values(e, ["user_id", "event_type"], "event_id", "value")


def vector_functions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    turned = F.reverse("v")
    return e.select("vec_id", F.round(dot(F.col("v"), turned), 6).alias("dot"), F.round(squared_norm(F.col("v"), 64), 6).alias("norm"))


def synthetic_ratings(spark, sf_dir):
    seeds = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"))
    flat, skewed = generated(seeds, 1000, 500), generated(seeds, 1000, 500, skew=5.0, tries=4)
    return flat.withColumn("law", F.lit("uniform")).unionByName(skewed.withColumn("law", F.lit("exponential")))


# Prediction and risk


def predict_ratings(spark, sf_dir):
    r = order_ratings(spark, sf_dir)
    made = predictions(r, *sides_of(r), RANK)
    return made.select("user", "item", F.round("prediction", 6).alias("prediction"))


def empirical_risk(spark, sf_dir):
    r = order_ratings(spark, sf_dir)
    return risk_of(r, *sides_of(r), 0.1, RANK).select(F.round("risk", 4).alias("risk"), "known")


def objective(spark, sf_dir):
    r = order_ratings(spark, sf_dir)
    return objective_of(r, *sides_of(r), 0.1, RANK).select(F.round("objective", 4).alias("objective"))


# SGD


def _step(spark, sf_dir):
    r = event_ratings(spark, sf_dir)
    return r.withColumn("u", INIT(F.col("user"))).withColumn("v", INIT(F.col("item")))


def sgd_single_step(spark, sf_dir):
    u, v = SGD(ETA).next_columns(F.col("rating"), F.col("u"), F.col("v"), RANK)
    return _step(spark, sf_dir).select("seq", u.alias("a"), v.alias("b")).select("seq", *spread("a", "u"), *spread("b", "v"))


def sgd_delta(spark, sf_dir):
    u, v = SGD(ETA).delta_columns(F.col("rating"), F.col("u"), F.col("v"), RANK)
    return _step(spark, sf_dir).select("seq", u.alias("a"), v.alias("b")).select("seq", *spread("a", "u"), *spread("b", "v"))


def sgd_sequential(spark, sf_dir):
    """The one sequence of all ratings: one task, as its ratings share items."""
    return rows_of(offline_dsgd(event_ratings(spark, sf_dir), INIT, SGD(ETA), blocks=1))


def dsgd_strata_k4(spark, sf_dir):
    return rows_of(offline_dsgd(event_ratings(spark, sf_dir), INIT, SGD(ETA), blocks=4))


def _known(spark, sf_dir):
    """All customers as known users, most of whom have rated nothing."""
    ids = table(spark, sf_dir, "customer").select(F.lit("user").alias("kind"), F.col("c_custkey").cast("int").alias("id"))
    return event_ratings(spark, sf_dir), ids.withColumn("vector", INIT(F.col("id") + 7))


def dsgd_known_vectors(spark, sf_dir):
    r, known = _known(spark, sf_dir)
    return rows_of(offline_dsgd(r, INIT, SGD(ETA), known=known, blocks=2))


def dsgd_updates_only(spark, sf_dir):
    r, known = _known(spark, sf_dir)
    return rows_of(offline_dsgd(r, INIT, SGD(ETA), known=known, blocks=2, updates_only=True))


def dsgd_regularized(spark, sf_dir):
    return rows_of(DSGD(rank=RANK, penalty=0.1, sweeps=1, blocks=2, eta=0.02, compat=True).fit(event_ratings(spark, sf_dir)).factors)


def als_factors(spark, sf_dir):
    """Of alternating least squares what any right solution shares: every user's vector solves its normal equations."""
    r = event_ratings(spark, sf_dir)
    made = als_residuals(r, stored(als(r, RANK, 5, seed=1, blocks=4), "als"))
    return made.select("user", F.round("residual", 3).alias("residual"))


# Streams


def online_trace(spark, sf_dir):
    log, _ = traced(event_ratings(spark, sf_dir), rank=RANK, eta=ETA, blocks=4)
    return log.select("seq", "user", "item", *spread("user_vector", "u"), *spread("item_vector", "v"))


def _batched(spark, sf_dir, parts):
    r = event_ratings(spark, sf_dir)
    return stored(r.withColumn("batch", batches(r, parts)), "batches", "batch")


def online_micro_batches(spark, sf_dir):
    r, model = _batched(spark, sf_dir, 3), Online(spark, rank=RANK, eta=ETA, blocks=2)
    for n in range(3):
        model.process(r.where(F.col("batch") == n), n)
    return rows_of(model.factors(2))


def online_with_offline(spark, sf_dir):
    r, model = _batched(spark, sf_dir, 3), Online(spark, rank=RANK, eta=ETA, blocks=2, retrain_every=2, retrain_sweeps=2)
    for n in range(3):
        model.process(r.where(F.col("batch") == n), n)
    return rows_of(model.factors(2))


def online_stream_trace(spark, sf_dir):
    """A row per rating, from the batches of a stream."""
    r, model = _batched(spark, sf_dir, 3), Online(spark, rank=RANK, eta=ETA, blocks=2, keep_trace=True)
    for n in range(3):
        model.process(r.where(F.col("batch") == n), n)
    log = model.trace(0).unionByName(model.trace(1)).unionByName(model.trace(2))
    return log.select("seq", "user", "item", *spread("user_vector", "u"), *spread("item_vector", "v"))


def running_fold(spark, sf_dir):
    r = _batched(spark, sf_dir, 3)
    none = spark.createDataFrame([], T.StructType([T.StructField("user", T.IntegerType()), T.StructField("n", T.LongType())]))
    add = lambda s, b: s.unionByName(b.groupBy("user").agg(F.count("*").alias("n"))).groupBy("user").agg(F.sum("n").alias("n"))
    process, _ = fold(spark, none, add)
    every = [process(r.where(F.col("batch") == n), n).withColumn("batch", F.lit(n)) for n in range(3)]
    return every[0].unionByName(every[1]).unionByName(every[2])


def running_fold_of_two(spark, sf_dir):
    r = _batched(spark, sf_dir, 2)
    none = spark.createDataFrame([], "id int, total double")
    add = lambda s, b, c: s.unionByName(b.select(F.col(c).alias("id"), F.col("rating").alias("total"))).groupBy("id").agg(F.sum("total").alias("total"))
    process, _ = fold2(spark, (none, none), lambda one, two, b: (add(one, b, "user"), add(two, b, "item")))
    for n in range(2):
        one, two = process(r.where(F.col("batch") == n), n)
    both = one.withColumn("kind", F.lit("user")).unionByName(two.withColumn("kind", F.lit("item")))
    return both.select("kind", "id", F.round("total", 4).alias("total"))


# Parameter server


def ps_bsp_round(spark, sf_dir):
    return rows_of(ps.offline(event_ratings(spark, sf_dir), rank=RANK, eta=0.0001))


def ps_sequential(spark, sf_dir):
    return rows_of(ps.offline(event_ratings(spark, sf_dir), rank=RANK, eta=ETA, batch=1, blocks=4))


def ps_minibatches(spark, sf_dir):
    """Bounded staleness between the extremes: four rounds over a quarter of the ratings each."""
    r = event_ratings(spark, sf_dir)
    return rows_of(ps.offline(r, rank=RANK, eta=0.0001, batch=-(-r.count() // 4)))


def ps_stale_items(spark, sf_dir):
    return rows_of(ps.stale_items(event_ratings(spark, sf_dir), rank=RANK, eta=0.0001, blocks=4))


def ps_offline_online(spark, sf_dir):
    r, server = _batched(spark, sf_dir, 3), OfflineOnline(spark, rank=RANK, eta=ETA, blocks=4)
    sign = spark.range(1)
    for n in range(3):
        server.process(server.with_triggers(r.where(F.col("batch") == n), sign.where(F.lit(n == 1))), n)
    return rows_of(server.factors(2))


QUERIES = [ratings_from_orders, rating_occurrence_counts, factor_init_lcg, block_assignment, block_strata, rating_block_arrays, item_arrays, state_merge, vector_sum_push, last_value_wins, vector_functions, synthetic_ratings, predict_ratings, empirical_risk, objective, sgd_single_step, sgd_delta, sgd_sequential, dsgd_strata_k4, dsgd_known_vectors, dsgd_updates_only, dsgd_regularized, als_factors, online_trace, online_micro_batches, online_with_offline, online_stream_trace, running_fold, running_fold_of_two, ps_bsp_round, ps_sequential, ps_minibatches, ps_stale_items, ps_offline_online]


def queries():
    return {f.__name__: f for f in QUERIES}


# The same in SQL

ORDERS = "SELECT o_custkey::INTEGER AS \"user\", l_partkey::INTEGER AS item, l_quantity / 50 AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
EVENTS = "SELECT user_id::INTEGER AS \"user\", (dense_rank() OVER (ORDER BY event_type) - 1)::INTEGER AS item, value / 100 AS rating, event_id AS seq FROM events"


def lcg(n: int) -> str:
    """SQL: a list of n uniforms of the generator with the seed ``id``, from a column of that name."""
    state, draws = "(xor(id::BIGINT, 25214903917) & 281474976710655)", []
    columns = []
    for k in range(2 * n):
        columns.append(f"s{k}")
    steps, prior = [], state
    for k in range(2 * n):
        steps.append((f"s{k}", f"(({prior})::HUGEINT * 25214903917 + 11) % 281474976710656"))
        prior = f"s{k}"
    draws = [f"((s{2 * k} // 4194304) * 134217728 + s{2 * k + 1} // 2097152)::DOUBLE * 1.1102230246251565e-16" for k in range(n)]
    out = "SELECT * FROM seeds"
    for name, expr in steps:
        out = f"SELECT *, {expr} AS {name} FROM ({out})"
    return f"SELECT id, [{', '.join(draws)}] AS vec FROM ({out})"


def init(ids: str, n: int = RANK) -> str:
    return f"WITH seeds AS (SELECT DISTINCT id FROM ({ids})) {lcg(n)}"


def four(expr: str, names: str = "f") -> str:
    return ", ".join(f"round({expr}[{i + 1}], 6) AS {names}{i}" for i in range(RANK))


def sgd(rows: str, *, eta: str = str(ETA), users: str | None = None, items: str | None = None, penalty: str = "0", trace: bool = False, more: str = "") -> str:
    """SQL of sequential SGD over rows (n from 1, "user", item, rating and, with a penalty, eta, wu, wv)."""
    users = users or init('SELECT "user" AS id FROM r')
    items = items or init("SELECT item AS id FROM r")
    e = f"{eta} * (rating - list_dot_product(p, q))"
    if penalty == "0":
        new_p, new_q = "list_transform(list_zip(p, q), lambda x: x[1] + e * x[2])", "list_transform(list_zip(p, q), lambda x: x[2] + e * x[1])"
    else:
        new_p = f"list_transform(list_zip(p, q), lambda x: x[1] - {eta} * ({penalty} / wu * x[1]) + e * x[2])"
        new_q = f"list_transform(list_zip(p, q), lambda x: x[2] - {eta} * ({penalty} / wv * x[2]) + e * x[1])"
    extra = ", eta, wu, wv" if penalty != "0" else ""
    head = f"""WITH RECURSIVE r AS MATERIALIZED ({rows}),
u0 AS ({users}), v0 AS ({items}),
run AS (
  SELECT 0::BIGINT AS n, (SELECT map_from_entries(list((id, vec))) FROM u0) AS us, (SELECT map_from_entries(list((id, vec))) FROM v0) AS vs, NULL::INTEGER AS "user", NULL::INTEGER AS item, NULL::DOUBLE[] AS a, NULL::DOUBLE[] AS b
  UNION ALL
  SELECT n, map_concat(us, MAP {{"user": a}}), map_concat(vs, MAP {{item: b}}), "user", item, a, b FROM (
    SELECT *, {new_p} AS a, {new_q} AS b FROM (
      SELECT *, {e} AS e FROM (
        SELECT r.n, us, vs, r."user", r.item, rating{extra}, us[r."user"] AS p, vs[r.item] AS q FROM run JOIN r ON r.n = run.n + 1))))
"""
    if trace:
        return head + f'SELECT r.seq, run."user", run.item, {four("a", "u")}, {four("b", "v")} FROM run JOIN r USING (n) WHERE run.n > 0'
    return head + f""", last AS (SELECT us, vs FROM run ORDER BY n DESC LIMIT 1),
rows AS (SELECT 'user' AS kind, unnest(map_entries(us)) AS x FROM last UNION ALL SELECT 'item', unnest(map_entries(vs)) FROM last)
SELECT kind, x.key AS id, {four("x.value")} FROM rows{more}"""


def ordered(source: str, order: str, extra: str = "") -> str:
    return f'SELECT row_number() OVER (ORDER BY {order}) AS n, "user", item, rating, seq{extra} FROM ({source})'


def stratified(k: int, ahead: bool = False) -> str:
    apart = f'(item % {k} - "user" % {k} + {k}) % {k}' if ahead else f'("user" % {k} - item % {k} + {k}) % {k}'
    return f'{apart}, "user" % {k}, seq'


def batch(parts: int) -> str:
    return f"(seq // ((SELECT max(event_id) + {parts} FROM events) // {parts}))"


def minibatches(rounds: int, eta: float = 0.0001) -> str:
    """SQL of rounds of gradient descent, each over the next part of the ratings in the order of seq."""
    own = {"user": '"user"', "item": "item"}
    parts = [f'WITH e AS ({EVENTS}), r AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // ((count(*) OVER () + {rounds - 1}) // {rounds}) AS turn FROM e)', *[f"{k}0 AS ({init(f'SELECT {c} AS id FROM r')})" for k, c in own.items()]]
    for n in range(rounds):
        parts.append(f'j{n} AS (SELECT r."user", r.item, a.vec AS u, b.vec AS v, {eta} * (rating - list_dot_product(a.vec, b.vec)) AS e FROM r JOIN user{n} a ON a.id = r."user" JOIN item{n} b ON b.id = r.item WHERE turn = {n})')
        for kind, c in own.items():
            other = "v" if kind == "user" else "u"
            sums = ", ".join(f"sum(e * {other}[{k + 1}])" for k in range(RANK))
            new = ", ".join(f"vec[{k + 1}] + coalesce(d[{k + 1}], 0)" for k in range(RANK))
            parts.append(f"{kind}{n + 1} AS (SELECT id, [{new}] AS vec FROM {kind}{n} LEFT JOIN (SELECT {c} AS id, [{sums}] AS d FROM j{n} GROUP BY 1) USING (id))")
    return ",\n".join(parts) + f" SELECT 'user' AS kind, id, {four('vec')} FROM user{rounds} UNION ALL SELECT 'item', id, {four('vec')} FROM item{rounds}"


#: Each user's ratings in turn, in the order (item, seq), against the items' first vectors; all users go on at once.
STALE = f"""WITH RECURSIVE e AS ({EVENTS}), r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY item, seq) AS k FROM e),
u0 AS ({init('SELECT "user" AS id FROM e')}), v0 AS ({init("SELECT item AS id FROM e")}),
run AS (
  SELECT 0::BIGINT AS k, id AS "user", vec AS p, NULL::INTEGER AS item, NULL::DOUBLE[] AS d FROM u0
  UNION ALL
  SELECT k, "user", list_transform(list_zip(p, q), lambda x: x[1] + e * x[2]), item, list_transform(p, lambda x: e * x) FROM (
    SELECT r.k, r."user", run.p, r.item, v0.vec AS q, 0.0001 * (r.rating - list_dot_product(run.p, v0.vec)) AS e FROM run JOIN r ON r."user" = run."user" AND r.k = run.k + 1 JOIN v0 ON v0.id = r.item))
SELECT 'user' AS kind, "user" AS id, {four("arg_max(p, k)")} FROM run GROUP BY "user"
UNION ALL SELECT 'item', item, {", ".join(f"round(any_value(vec[{k + 1}]) + sum(d[{k + 1}]), 6)" for k in range(RANK))} FROM run JOIN v0 ON v0.id = run.item GROUP BY item"""


def oracle_sql() -> dict[str, str]:
    both = 'SELECT "user" AS id FROM r UNION SELECT item FROM r'
    with_orders = f'WITH r AS ({ORDERS}), i AS ({init(both)}), j AS (SELECT r.*, a.vec AS u, b.vec AS v FROM r JOIN i a ON a.id = r."user" JOIN i b ON b.id = r.item)'
    with_events = f'WITH r AS ({EVENTS}), i AS ({init(both)}), j AS (SELECT r.*, a.vec AS u, b.vec AS v, {ETA} * (rating - list_dot_product(a.vec, b.vec)) AS e FROM r JOIN i a ON a.id = r."user" JOIN i b ON b.id = r.item)'
    vec = lambda x: f"list_transform(list_zip(u, v), lambda x: {x})"
    delta_u, delta_v = "list_transform(v, lambda x: e * x)", "list_transform(u, lambda x: e * x)"
    pick = lambda first, n: "coalesce(" + ", ".join(f"CASE WHEN floor(-ln(1 - vec[{first + 2 * t}]) / 5.0 * {n}) < {n} THEN floor(-ln(1 - vec[{first + 2 * t}]) / 5.0 * {n}) END" for t in range(4)) + ")::INTEGER"
    known = """SELECT (id - 7)::INTEGER AS id, vec FROM (""" + init("SELECT c_custkey::INTEGER + 7 AS id FROM customer") + ")"
    touched = f"""SELECT id, vec FROM ({known}) WHERE id IN (SELECT "user" FROM r) UNION ALL
SELECT id, vec FROM ({init('SELECT "user" AS id FROM r')}) WHERE id NOT IN (SELECT c_custkey FROM customer)"""
    untouched = f""" UNION ALL SELECT 'user', id, {four("vec")} FROM ({known}) WHERE id NOT IN (SELECT "user" FROM r)"""
    weights = 'SELECT *, count(*) OVER (PARTITION BY "user") AS wu, count(*) OVER (PARTITION BY item) AS wv, 0.02 / sqrt(1 + ((item % 2 - "user" % 2 + 2) % 2)) AS eta FROM (' + EVENTS + ")"
    retrained = f"SELECT * FROM (SELECT *, 0 AS turn FROM ({EVENTS}) WHERE {batch(3)} < 2 UNION ALL SELECT *, 1 AS turn FROM ({EVENTS}))"
    gradient = f"""WITH r AS ({EVENTS}), i AS ({init(both)}), j AS (SELECT r.*, a.vec AS u, b.vec AS v, 0.0001 * (rating - list_dot_product(a.vec, b.vec)) AS e FROM r JOIN i a ON a.id = r."user" JOIN i b ON b.id = r.item),
d AS (SELECT 'user' AS kind, "user" AS id, u AS old, {delta_u} AS d FROM j UNION ALL SELECT 'item', item, v, {delta_v} FROM j)
SELECT kind, id, {', '.join(f'round(any_value(old[{k + 1}]) + sum(d[{k + 1}]), 6) AS f{k}' for k in range(RANK))} FROM d GROUP BY kind, id"""
    return {
        "ratings_from_orders": f'SELECT "user", item, round(rating, 6) AS rating FROM ({ORDERS})',
        "rating_occurrence_counts": f"WITH r AS ({ORDERS}) SELECT 'user' AS kind, \"user\" AS id, count(*) AS omega FROM r GROUP BY 2 UNION ALL SELECT 'item', item, count(*) FROM r GROUP BY 2",
        "factor_init_lcg": f"""WITH ids AS (SELECT 'user' AS kind, c_custkey::INTEGER AS id FROM customer UNION ALL SELECT 'item', p_partkey::INTEGER FROM part), i AS ({init('SELECT id FROM ids')})
SELECT kind, id, {', '.join(f'vec[{k + 1}] AS f{k}' for k in range(RANK))} FROM ids JOIN i USING (id)""",
        "block_assignment": "SELECT c_custkey::INTEGER AS id, (c_custkey % 8)::INTEGER AS block, (c_custkey % 8)::INTEGER AS negative_block, ((c_custkey % 8 + 3) % 8)::INTEGER AS shifted, (c_custkey % 8 * 9)::INTEGER AS first, (c_custkey % 8 * 8 + (c_custkey % 8 + 1) % 8)::INTEGER AS next_user, ((c_custkey % 8 + 7) % 8 * 8 + c_custkey % 8)::INTEGER AS next_item FROM customer",
        "block_strata": f'SELECT ("user" % 4 * 4 + item % 4)::INTEGER AS rating_block, (("user" % 4 - item % 4 + 4) % 4)::INTEGER AS behind, ((item % 4 - "user" % 4 + 4) % 4)::INTEGER AS ahead, count(*) AS n FROM ({ORDERS}) GROUP BY 1, 2, 3',
        "rating_block_arrays": f'WITH r AS ({EVENTS}), o AS (SELECT *, "user" % 3 * 3 + item % 3 AS b, row_number() OVER (PARTITION BY "user" % 3 * 3 + item % 3 ORDER BY "user", item, rating, seq) AS k FROM r) SELECT b::INTEGER AS rating_block, count(*) AS n, max(CASE WHEN k = 1 THEN "user" END) AS first_user, max(CASE WHEN k = 1 THEN item END) AS first_item, round(sum(rating), 4) AS total FROM o GROUP BY b',
        "item_arrays": f'WITH r AS ({EVENTS}), o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY "user", item, rating, seq) AS k FROM r) SELECT item, count(*) AS n, max(CASE WHEN k = 1 THEN "user" END) AS first_user, max(CASE WHEN k = 1 THEN item END) AS first_item, round(sum(rating), 4) AS total FROM o GROUP BY item',
        "state_merge": "WITH n AS (SELECT (user_id * 2)::INTEGER AS id, max(value) AS x FROM events GROUP BY 1) SELECT coalesce(c_custkey::INTEGER, n.id) AS id, coalesce(n.x, c_acctbal) AS x FROM customer FULL JOIN n ON c_custkey = n.id",
        "vector_sum_push": "WITH e AS (SELECT label, embedding, unnest(range(0, len(embedding))) AS k FROM embeddings) SELECT label AS id, k::INTEGER AS place, round(sum(embedding[k + 1]::DOUBLE), 6) AS total FROM e GROUP BY 1, 2",
        "last_value_wins": "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
        "vector_functions": "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 6) AS dot, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm FROM embeddings",
        "synthetic_ratings": f"""WITH d AS ({init('SELECT event_id AS id FROM events', 9)}), m AS (SELECT floor(vec[2] * 1000)::INTEGER AS "user", floor(vec[3] * 500)::INTEGER AS item, id, 'uniform' AS law FROM d UNION ALL SELECT {pick(2, 1000)}, {pick(3, 500)}, id, 'exponential' FROM d)
SELECT "user", item, 1.0::DOUBLE AS rating, id::BIGINT AS seq, law FROM m WHERE "user" IS NOT NULL AND item IS NOT NULL""",
        "predict_ratings": f'{with_orders} SELECT "user", item, round(list_dot_product(u, v), 6) AS prediction FROM j',
        "empirical_risk": f"{with_orders} SELECT round(sum((rating - list_dot_product(u, v)) ** 2 + 0.1 * (list_dot_product(u, u) + list_dot_product(v, v))), 4) AS risk, count(*) AS known FROM j",
        "objective": f'{with_orders} SELECT round((SELECT sum((rating - list_dot_product(u, v)) ** 2) FROM j) + 0.1 * ((SELECT sum(list_dot_product(vec, vec)) FROM i WHERE id IN (SELECT "user" FROM r)) + (SELECT sum(list_dot_product(vec, vec)) FROM i WHERE id IN (SELECT item FROM r))), 4) AS objective',
        "sgd_single_step": f"{with_events} SELECT seq, {four(vec('x[1] + e * x[2]'), 'u')}, {four(vec('x[2] + e * x[1]'), 'v')} FROM j",
        "sgd_delta": f"{with_events} SELECT seq, {four(delta_u, 'u')}, {four(delta_v, 'v')} FROM j",
        "sgd_sequential": sgd(ordered(EVENTS, "seq")),
        "dsgd_strata_k4": sgd(ordered(EVENTS, stratified(4))),
        "dsgd_known_vectors": sgd(ordered(EVENTS, stratified(2)), users=touched, more=untouched),
        "dsgd_updates_only": sgd(ordered(EVENTS, stratified(2)), users=touched),
        "dsgd_regularized": sgd(ordered(weights, stratified(2, True), ", eta, wu, wv"), eta="eta", penalty="0.1"),
        "online_trace": sgd(ordered(EVENTS, stratified(4)), trace=True),
        "online_stream_trace": sgd(ordered(EVENTS, f"{batch(3)}, {stratified(2)}"), trace=True),
        "als_factors": f'SELECT DISTINCT "user", 0.0::DOUBLE AS residual FROM ({EVENTS})',
        "online_micro_batches": sgd(ordered(EVENTS, f"{batch(3)}, {stratified(2)}")),
        "online_with_offline": sgd(ordered(retrained, f"turn, {batch(3)} = 2, {stratified(2)}")),
        "running_fold": f'WITH b AS (SELECT "user", {batch(3)} AS b FROM ({EVENTS})), n AS (SELECT unnest([0, 1, 2]) AS batch) SELECT "user", count(*) AS n, batch::INTEGER AS batch FROM b JOIN n ON b <= batch GROUP BY 1, 3',
        "running_fold_of_two": f"WITH r AS ({EVENTS}) SELECT 'user' AS kind, \"user\" AS id, round(sum(rating), 4) AS total FROM r GROUP BY 2 UNION ALL SELECT 'item', item, round(sum(rating), 4) FROM r GROUP BY 2",
        "ps_bsp_round": gradient,
        "ps_sequential": sgd(ordered(EVENTS, stratified(4))),
        "ps_minibatches": minibatches(4),
        "ps_stale_items": STALE,
        "ps_offline_online": sgd(ordered(EVENTS, f"{batch(3)} = 2, {stratified(4)}")),
    }
