"""Batch training: stratified SGD and alternating least squares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rates
from ..functions.initialisers import Initialiser, pseudo_random
from ..functions.updates import RegularizedSGD, Updater
from ..functions.vectors import dot
from ..plans.strata import complete, descend, start
from .predict import empirical_risk, objective, predictions
from .state import side, summed


def offline_dsgd(ratings: DataFrame, init: Initialiser, updater: Updater, *, known: DataFrame | None = None, blocks: int | None = None, sweeps: int = 1, updates_only: bool = False, item_init: Initialiser | None = None, block=None) -> DataFrame:
    """kind, id, vector after stratified SGD from the known vectors (or initial ones).

    updates_only: of the ids that a rating touched, else of all, the untouched known ones included.
    Ratings with a null user, item or rating take no part; ``start`` tells of known vectors.
    """
    vectors, _ = descend(ratings, start(ratings, init, known, item_init), updater, blocks=blocks, sweeps=sweeps, block=block)
    return (vectors.where("touched") if updates_only else vectors).select("kind", "id", "vector")


@dataclass
class DSGD:
    """Regularised stratified SGD with a learning-rate schedule; ``fit`` gives a model."""

    rank: int = 10
    penalty: float = 1.0
    sweeps: int = 10
    blocks: int | None = None
    seed: int = 0
    eta: float = 0.001
    rate: rates.Rate = rates.default
    init: Initialiser | None = None
    compat: bool = False

    def __post_init__(self):
        for name in ("rank", "sweeps", "blocks"):
            if getattr(self, name) is not None and getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    def fit(self, ratings: DataFrame) -> Model:
        vectors, _ = descend(ratings, start(ratings, self.init or pseudo_random(self.rank, self.seed)), lambda eta: RegularizedSGD(eta, self.penalty), blocks=self.blocks, sweeps=self.sweeps, direction="ahead", rate=self.rate, eta=self.eta, penalty=self.penalty, compat=self.compat)
        return Model(vectors.select("kind", "id", "vector"), self.penalty, None if self.init else self.rank)


@dataclass
class Model:
    """Factor vectors (kind, id, vector) and what is asked of them."""

    factors: DataFrame | None
    penalty: float = 1.0
    rank: int | None = None

    def _sides(self) -> tuple[DataFrame, DataFrame]:
        if self.factors is None:
            raise RuntimeError("the factor model has not been fitted")
        return side(self.factors, "user"), side(self.factors, "item")

    def predict(self, pairs: DataFrame) -> DataFrame:
        return predictions(pairs, *self._sides(), self.rank)

    def empirical_risk(self, ratings: DataFrame) -> DataFrame:
        return empirical_risk(ratings, *self._sides(), self.penalty, self.rank)

    def objective(self, ratings: DataFrame) -> DataFrame:
        return objective(ratings, *self._sides(), self.penalty, self.rank)


def als(ratings: DataFrame, rank: int = 10, sweeps: int = 10, penalty: float = 0.1, seed: int = 0, blocks: int = 10) -> DataFrame:
    """kind, id, vector by explicit alternating least squares."""
    from pyspark.ml.recommendation import ALS

    model = ALS(rank=rank, maxIter=sweeps, regParam=penalty, seed=seed, numUserBlocks=blocks, numItemBlocks=blocks, userCol="user", itemCol="item", ratingCol="rating").fit(ratings.select("user", "item", F.col("rating").cast("float")))
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("id").cast("int").alias("id"), F.col("features").cast("array<double>").alias("vector"))
    return one(model.userFactors, "user").unionByName(one(model.itemFactors, "item"))


def als_residuals(ratings: DataFrame, factors: DataFrame, penalty: float = 0.1) -> DataFrame:
    """user, residual: by how much each user's vector, the side solved last, misses its normal equations.

    The largest place of sum((u.v - r) v) + penalty n u over the user's n ratings,
    divided by 1 + n: zero but for the rounding of vectors to 32 bits.
    """
    u, v = (side(factors, k).select(F.col("id").alias(k), F.col("vector").alias(k[0] + "_vector")) for k in ("user", "item"))
    rows = complete(ratings).join(u, "user").join(v, "item")
    error = dot(F.col("u_vector"), F.col("i_vector")) - F.col("rating").cast("float").cast("double")
    each = rows.select(F.col("user").alias("id"), F.zip_with("u_vector", "i_vector", lambda a, b: error * b + penalty * a).alias("vector"))
    counts = complete(ratings).groupBy(F.col("user").alias("id")).agg(F.count("*").alias("n"))
    return summed(each).join(counts, "id").select(F.col("id").alias("user"), (F.array_max(F.transform("vector", lambda x: F.abs(x))) / (1 + F.col("n"))).alias("residual"))
