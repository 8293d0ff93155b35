"""Online SGD over micro-batches, with state by version.

Each micro-batch reads the state of the batch before, and writes its own under its
number, so a batch that runs again after a failure gives the same and nothing twice.
Only the vectors that a batch changes are written with it. Now and then they are
merged to a new base, so the cost of a batch follows the batch and not the model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.initialisers import Initialiser, pseudo_random
from ..functions.updates import SGD, Updater
from ..operators.state import bag_union, last_values
from ..operators.train import als, offline_dsgd
from ..plans.strata import descend, start
from ..sources.store import History, VersionedState, delete, stored


def due(batch: int, every: int | None) -> bool:
    """True for batches every - 1, 2 every - 1, ... (from 0); None or -1 is never."""
    if every is None or every == -1:
        return False
    if every < 1:
        raise ValueError("a period is at least 1, or None for never")
    return (batch + 1) % every == 0


@dataclass
class Online:
    """Online factorization, by default with plain SGD; with ``retrain_every`` it trains anew on all history now and then.

    ``process`` is what ``foreachBatch`` calls. Updates of batch n are in ``updates(n)``;
    with ``keep_trace``, ``trace(n)`` has a row per rating of an online batch, with both
    vectors as it left them.
    """

    #: Whether ratings are kept for a training that no period announces.
    remembers = False

    spark: SparkSession
    rank: int = 10
    eta: float = 0.001
    blocks: int | None = None
    init: Initialiser | None = None
    updater: Updater | None = None
    retrain_every: int | None = None
    retrain: str = "DSGD"
    retrain_sweeps: int = 10
    path: str | None = None
    compact_every: int = 8
    keep_trace: bool = False
    state: VersionedState = field(init=False)
    history: History = field(init=False)

    def __post_init__(self):
        due(0, self.retrain_every)
        due(0, self.compact_every)
        if self.retrain not in ("DSGD", "ALS"):
            raise ValueError("retrain is DSGD or ALS")
        self.init, self.updater = self.init or pseudo_random(self.rank), self.updater or SGD(self.eta)
        self.state = VersionedState(self.spark, self.path and f"{self.path}/state", keep=2 * self.compact_every + 1)
        self.history = History(self.spark, self.path and f"{self.path}/history")

    def process(self, batch: DataFrame, number: int, retrain: bool | None = None) -> DataFrame:
        """Take a batch; returns the vectors it changed. retrain: train on all history now, whatever the period says."""
        batch = stored(batch.select("user", "item", "rating", "seq"), "batch")
        if self.remembers or self.retrain_every not in (None, -1):
            self.history.append(batch, number)
        if due(number, self.retrain_every) if retrain is None else retrain:
            every = self.history.upto(number)
            if self.retrain == "ALS":
                after = als(every, self.rank, self.retrain_sweeps)
            else:
                after = offline_dsgd(every, self.init, self.updater, blocks=self.blocks, sweeps=self.retrain_sweeps)
            self._rebase(after, number)
            return self.state.write(self.state.read(number, "base"), number, "updates")
        known = self.factors(number - 1)
        if known is not None:  # only the vectors that the batch needs move
            known = known.join(start(batch, self.init).select("kind", "id"), ["kind", "id"], "left_semi")
        vectors, log = descend(batch, start(batch, self.init, known), self.updater, blocks=self.blocks, trace=self.keep_trace)
        made = vectors.where("touched").select("kind", "id", "vector")
        if log is not None:
            self.state.write(log.drop("step"), number, "trace")
        updates = self.state.write(made, number, "updates")
        if due(number, self.compact_every):
            self._rebase(self.factors(number), number)
        return updates

    def _rebase(self, df: DataFrame, number: int) -> None:
        """Write a new base; the one before stays for a batch that runs again, older ones go."""
        self.state.write(df, number, "base")
        last = self.state.newest(number - 1, "base")
        if last is not None and (older := self.state.newest(last - 1, "base")) is not None:
            delete(self.spark, self.state.at(older, "base"))

    def updates(self, number: int) -> DataFrame:
        return self.spark.read.parquet(self.state.at(number, "updates"))

    def trace(self, number: int) -> DataFrame:
        """seq, user, item, user_vector, item_vector of each rating of a batch that was processed online."""
        return self.spark.read.parquet(self.state.at(number, "trace"))

    def factors(self, number: int) -> DataFrame | None:
        """All vectors after a batch: the newest base, and of the later updates the last of each id."""
        base = self.state.newest(number, "base")
        first = 0 if base is None else base + 1
        parts = [self.spark.read.parquet(self.state.at(base, "base")).withColumn("v", F.lit(base))] if base is not None else []
        parts += [self.updates(n).withColumn("v", F.lit(n)) for n in range(first, number + 1)]
        if len(parts) < 2:
            return parts[0].drop("v") if parts else None
        return last_values(bag_union(*parts), ["kind", "id"], "v")

    def start(self, ratings: DataFrame, checkpoint: str, **trigger):
        """Start the query over a stream of ratings; by default it takes what is there and ends."""
        run = lambda df, n: self.process(df, n) and None
        return ratings.writeStream.foreachBatch(lambda df, n: run(df, n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


@dataclass
class OfflineOnline(Online):
    """Online training that a stream of triggers interrupts.

    A batch that holds a trigger starts both sides anew and trains ``retrain_sweeps``
    times on all ratings up to it, its own included; later batches go on online from
    there. Batches hold ratings and triggers in one stream (``with_triggers``), so a
    batch that runs again finds the same, and state by version makes it do the same.
    """

    retrain_sweeps: int = 1
    remembers = True

    @staticmethod
    def with_triggers(ratings: DataFrame, triggers: DataFrame) -> DataFrame:
        """ratings, and a row per row of triggers that has ``trigger`` true and nothing else."""
        signs = triggers.select(F.lit(None).cast("int").alias("user"), F.lit(None).cast("int").alias("item"), F.lit(None).cast("double").alias("rating"), F.lit(None).cast("long").alias("seq"), F.lit(True).alias("trigger"))
        return ratings.select("user", "item", "rating", "seq", F.lit(False).alias("trigger")).unionByName(signs)

    def process(self, batch: DataFrame, number: int, retrain: bool | None = None) -> DataFrame:
        if "trigger" in batch.columns:
            retrain = not batch.where("trigger").isEmpty()
            batch = batch.where("not trigger")
        return super().process(batch, number, bool(retrain))


def to_console(updates: DataFrame, checkpoint: str, rows: int = 20, mode: str = "append", **trigger):
    """Print each micro-batch of a stream; by default what is there, once."""
    return updates.writeStream.format("console").outputMode(mode).option("numRows", rows).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fold(spark: SparkSession, first: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], path: str | None = None):
    """A running fold: (process, state). process(batch, n) writes and returns step(state of n - 1, batch); state.read(n) is the state."""
    state = VersionedState(spark, path)
    state.write(first, -1)

    def process(batch: DataFrame, number: int) -> DataFrame:
        return state.write(step(state.read(number - 1), batch), number)

    return process, state


def fold2(spark: SparkSession, first: tuple[DataFrame, DataFrame], step: Callable[[DataFrame, DataFrame, DataFrame], tuple[DataFrame, DataFrame]], path: str | None = None):
    """A fold of two states: process returns both."""
    state = VersionedState(spark, path)
    for name, df in zip(("one", "two"), first, strict=True):
        state.write(df, -1, name)

    def process(batch: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        one, two = step(state.read(number - 1, "one"), state.read(number - 1, "two"), batch)
        return state.write(one, number, "one"), state.write(two, number, "two")

    return process, state


def traced(ratings: DataFrame, *, rank: int = 10, eta: float = 0.001, blocks: int | None = None, init: Initialiser | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(trace, vectors): a row per rating with both vectors as it left them; each user's ratings in the order of seq."""
    init = init or pseudo_random(rank)
    vectors, log = descend(ratings, start(ratings, init, known), SGD(eta), blocks=blocks, trace=True)
    return log.drop("step"), vectors.select("kind", "id", "vector")
