"""Where ratings come from: tables, memory, files, streams and generators.

A frame of ratings has user, item (int), rating (double) and seq (long): SGD is
order-sensitive and a frame has no order, so seq carries one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.vectors import exponential_of, lcg_uniforms

RATINGS = T.StructType([T.StructField("user", T.IntegerType()), T.StructField("item", T.IntegerType()), T.StructField("rating", T.DoubleType()), T.StructField("seq", T.LongType())])


def as_ratings(df: DataFrame, user="user", item="item", rating="rating", seq="seq") -> DataFrame:
    """Checked casts of any frame's columns (or expressions) to ratings; an id beyond 32 bits is an error."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(column(user).cast("int").alias("user"), column(item).cast("int").alias("item"), column(rating).cast("double").alias("rating"), column(seq).cast("long").alias("seq"))


def from_memory(spark: SparkSession, rows) -> DataFrame:
    """Ratings (user, item, rating) in the order given."""
    return spark.createDataFrame([(u, i, float(r), n) for n, (u, i, r) in enumerate(rows)], RATINGS)


def from_csv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """user,item,rating,seq lines; the schema is given, not inferred."""
    return spark.read.schema(RATINGS).csv(path, header=header)


def from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Who ordered what: customer, part, quantity / 50. seq is the order's key, which is no total order."""
    joined = lineitem.select("l_orderkey", "l_partkey", "l_quantity").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return as_ratings(joined, "o_custkey", "l_partkey", F.col("l_quantity") / 50, "l_orderkey")


def from_events(events: DataFrame) -> DataFrame:
    """The ordered rating stream: user, the event type's place in the alphabet from 0, value / 100, event_id."""
    kinds = events.select("event_type").distinct()
    ranked = kinds.withColumn("item", F.row_number().over(Window.orderBy("event_type")) - 1)
    return as_ratings(events.join(ranked, "event_type"), "user_id", "item", F.col("value") / 100, "event_id")


def stream_files(spark: SparkSession, path: str, per_batch: int = 1, schema: T.StructType = RATINGS) -> DataFrame:
    """A stream of ratings from Parquet files, so many in each micro-batch, oldest first; with ``processingTime`` triggers it limits the rate."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def stream_rate(spark: SparkSession, per_second: int, users: int, items: int, skew: float | None = None) -> DataFrame:
    """An unbounded generated stream at a nominal rate."""
    source = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return generated(source.select(F.col("value").alias("seq")), users, items, skew)


def discrete(uniform: Column, n: int, skew: float | None, compat: bool = False) -> Column:
    """An id below n from a uniform draw; with skew the exponential law, null for a draw to be rejected.

    compat also lets n itself through.
    """
    if skew is None:
        return F.floor(uniform * n)
    x = F.floor(exponential_of(uniform, skew) * n)
    return F.when(x <= n if compat else x < n, x)


def generated(seeds: DataFrame, users: int, items: int, skew: float | None = None, *, tries: int = 8, compat: bool = False) -> DataFrame:
    """A rating of 1.0 per row of seeds (seq), ids uniform or exponential with the rate ``skew``.

    Draws come from the seeded 48-bit generator of each seq, so that a row is the
    same wherever and however often it is made. The first draw of small seeds is
    nearly constant and is skipped. A rejected draw takes the next pair; a row whose
    ``tries`` pairs are all rejected (a chance of exp(-skew * tries)) is left out.
    """
    u = lcg_uniforms(F.col("seq"), 1 + 2 * tries)
    pick = lambda first, n: F.coalesce(*[discrete(u[first + 2 * t], n, skew, compat) for t in range(tries)])
    made = seeds.select(pick(1, users).cast("int").alias("user"), pick(2, items).cast("int").alias("item"), F.lit(1.0).alias("rating"), F.col("seq").cast("long").alias("seq"))
    return made.where("user is not null and item is not null")


def batches(ratings: DataFrame, parts: int) -> Column:
    """The micro-batch of each rating when seq, from 0 to n - 1, is cut in ``parts`` equal ranges."""
    n = ratings.agg(F.max("seq").alias("n")).first()["n"]
    size = max(1, -(-((n or 0) + 1) // parts))
    return F.floor(F.col("seq") / size).cast("int")
