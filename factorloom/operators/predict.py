"""Predictions and risk of a factor model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, squared_norm


def predictions(pairs: DataFrame, users: DataFrame, items: DataFrame, rank: int | None = None) -> DataFrame:
    """user, item, prediction for each row of pairs whose user and item are both known; repeated rows stay.

    The sides join by the optimizer's choice: broadcast while they are small, else
    by shuffle, with AQE splitting a frequent user or item.
    """
    u = users.select(F.col("id").alias("user"), F.col("vector").alias("__u"))
    v = items.select(F.col("id").alias("item"), F.col("vector").alias("__v"))
    return pairs.select("user", "item").join(u, "user").join(v, "item").select("user", "item", dot(F.col("__u"), F.col("__v"), rank).alias("prediction"))


def rated_with_vectors(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    u = users.select(F.col("id").alias("user"), F.col("vector").alias("u"))
    v = items.select(F.col("id").alias("item"), F.col("vector").alias("v"))
    return ratings.select("user", "item", "rating").join(u, "user").join(v, "item")


def empirical_risk(ratings: DataFrame, users: DataFrame, items: DataFrame, penalty: float = 1.0, rank: int | None = None) -> DataFrame:
    """One row: risk, the sum over ratings of the squared error and penalty (|u|^2 + |v|^2); known, the ratings it covers.

    Each copy of a rating counts once. Ratings of unknown ids are left out. No known rating gives no row.
    """
    rows = rated_with_vectors(ratings, users, items)
    e = F.col("rating") - dot(F.col("u"), F.col("v"), rank)
    term = e * e + penalty * (squared_norm(F.col("u"), rank) + squared_norm(F.col("v"), rank))
    return rows.agg(F.sum(term).alias("risk"), F.count("*").alias("known")).where("known > 0")


def objective(ratings: DataFrame, users: DataFrame, items: DataFrame, penalty: float = 1.0, rank: int | None = None) -> DataFrame:
    """One row: objective, the squared errors' sum and the penalty once for every user and item vector."""
    e = F.col("rating") - dot(F.col("u"), F.col("v"), rank)
    errors = rated_with_vectors(ratings, users, items).agg(F.sum(e * e).alias("errors"))
    norms = users.select("vector").unionByName(items.select("vector")).agg(F.sum(squared_norm(F.col("vector"), rank)).alias("norms"))
    return errors.join(norms, F.lit(True)).select((F.coalesce("errors", F.lit(0.0)) + penalty * F.coalesce("norms", F.lit(0.0))).alias("objective"))
