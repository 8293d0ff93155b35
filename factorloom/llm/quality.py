"""Quality classification of whole texts.

Random indexing gives each word a sparse ternary index vector, a function of the word
alone, and words of a bounded vocabulary also the sum of their neighbours' index
vectors in a sample. A text is the mean of its words' vectors, once over all its words
and once over its different words; a word outside the vocabulary counts with its index
vector. A two-layer network in numpy scores that pooled vector; a temperature, fitted
on rows the network did not see, calibrates the probability.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_of, one_thread, own_name, table, tidied

#: Words: runs of word characters, or of signs.
WORD = re.compile(r"\w+|[^\w\s]+")
SIZE, ONES = 64, 8


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@functools.cache
def index_vectors(seed: int = 2) -> np.ndarray:
    """Sparse ternary vectors of length 1, one for each of 65,536 hashes; every process makes the same."""
    rng = np.random.default_rng(seed)
    at = rng.random((1 << 16, SIZE), np.float32).argpartition(ONES, axis=1)[:, :ONES]
    out = np.zeros((1 << 16, SIZE), np.float32)
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), at.shape) / np.sqrt(np.float32(ONES)), axis=1)
    return out


def index_of(found) -> np.ndarray:
    """The index vectors of words."""
    return index_vectors()[np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & 0xFFFF for w in found), np.int64)]


class WordVectors:
    """Random-indexing vectors: of the ``most`` most frequent words that occur twice, with their neighbours; of any other word its index vector."""

    def __init__(self, texts: list[str | None], most: int = 20_000, reach: int = 2):
        seen = [words(t) for t in texts]
        counts = Counter(w for t in seen for w in t)
        kept = sorted(((w, n) for w, n in counts.items() if n > 1), key=lambda x: (-x[1], x[0]))[:most]
        self.places = {w: i for i, (w, _) in enumerate(kept)}
        total = np.zeros((len(kept), SIZE), np.float32)
        for t in seen:
            near, ids = index_of(t), np.fromiter((self.places.get(w, -1) for w in t), np.int64, len(t))
            for d in range(1, reach + 1):
                for one, other in ((slice(None, -d), slice(d, None)), (slice(d, None), slice(None, -d))):
                    known = ids[one] >= 0
                    np.add.at(total, ids[one][known], near[other][known])
        norms = np.linalg.norm(total, axis=1, keepdims=True)
        self.vectors = (total / np.where(norms, norms, 1) + index_of(self.places)).astype(np.float32)

    def pooled(self, text: str | None) -> np.ndarray:
        """The mean over all words, that over different words, how far they are apart, the share of the most frequent word, those outside the vocabulary, and the logarithms of both numbers of words; zeros if there are none."""
        counts = Counter(words(text))
        if not counts:
            return np.zeros(2 * SIZE + 6, np.float32)
        ids = np.fromiter((self.places.get(w, -1) for w in counts), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float32, len(counts))
        rows, strange = np.empty((len(counts), SIZE), np.float32), ids < 0
        rows[~strange] = self.vectors[ids[~strange]]
        if strange.any():
            rows[strange] = index_of(w for w, x in zip(counts, strange.tolist(), strict=True) if x)
        every, once = (n / n.sum()) @ rows, rows.mean(0)
        apart = every - once
        return np.concatenate([every, once, [np.sqrt(apart @ apart), n.max() / n.sum(), n[strange].sum() / n.sum(), strange.mean(), np.log1p(n.sum()), np.log1p(len(n))]]).astype(np.float32)


class Network:
    """Two layers with tanh between, trained by Adam on the log loss; inputs are standardised."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 300, rate: float = 0.01, decay: float = 1e-3, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        self.p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for t in range(1, rounds + 1):
            h = np.tanh(z @ self.p[0] + self.p[1])
            error = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - y) / len(y)
            back = np.outer(error, self.p[2]) * (1 - h * h)
            grads = [z.T @ back + decay * self.p[0], back.sum(0), h.T @ error + decay * self.p[2], error.sum(keepdims=True)]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, from a fixed grid."""
    grid = np.exp(np.linspace(-1.5, 2.5, 81))
    loss = [np.logaddexp(0, -np.where(y > 0, 1, -1) * logits / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class QualityModel:
    def __init__(self, texts: list[str | None], y: np.ndarray):
        self.constant = float(y.mean()) if len(y) and len(set(y.tolist())) == 1 else (0.5 if not len(y) else None)
        if self.constant is not None:
            return
        apart = np.arange(len(y)) % 5 == 4
        if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
            apart[:] = False
        self.words = WordVectors([t for t, a in zip(texts, apart, strict=True) if not a])
        x = np.stack([self.words.pooled(t) for t in texts])
        self.net = Network(x[~apart], y[~apart])
        self.temperature = fit_temperature(self.net.logits(x[apart]), y[apart]) if apart.any() else 1.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant if self.constant is not None else 0.5)
        logits = self.net.logits(np.stack([self.words.pooled(t) for t in texts]))
        # Rounded: the last bits of a product depend on how many rows are multiplied at once.
        return np.round(1 / (1 + np.exp(-np.clip(logits / self.temperature, -30, 30))), 9)


def fit(docs: DataFrame, labels: DataFrame, learns, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, rows: int = 3000) -> QualityModel:
    """Fit on at most ``rows`` labelled rows for which ``learns`` holds, which the order of a hash draws.

    Whole texts train, long and empty ones too. Of several texts of an id the smallest
    in order is taken, so the same tables give the same model.
    """
    drawn = labels.where(learns & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    drawn = drawn.orderBy(F.xxhash64("id"), "id", "y").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    got = texts.join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    got = sorted(((r["id"], r["y"], r["text"]) for r in got), key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    with one_thread():
        return QualityModel([r[2] for r in got], np.array([r[1] for r in got], np.float64))


def score(df: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score", at_once: int = 256) -> DataFrame:
    """df with the probability that a whole text is of good quality, as ``out`` (``out_1`` and so on where df has that name).

    Null and empty texts get the score of a text without words, equal texts equal
    scores; repeated rows, null ids and all columns stay; an empty table gives an empty
    result; texts of any length are read whole. Without a labelled row all scores are
    0.5, with one label alone they are that label. The model, at most
    20,000 words and their vectors, travels with the function.
    """
    at, out = df.columns.index(text_col), own_name(df, out)

    @tidied
    def each(batches):
        for batch in batches:
            made = [model.scores([t.as_py() for t in batch.column(at).slice(lo, at_once)]) for lo in range(0, batch.num_rows, at_once)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(made) if made else [], pa.float64())], names=[*batch.schema.names, out])

    return df.mapInArrow(each, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    """True for rows that no model learns from; a null id is one of them."""
    return F.coalesce(crc32_of(F.col(id_col)) % 4 == 2, F.lit(True))


def op3_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, ~held_out())
    scored = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
