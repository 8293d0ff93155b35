"""Language identification by nearest centroids of TF-IDF character n-grams.

A text's letters, in lower case, give 1- to 3-grams (everything else is one
separator), hashed to ``BINS`` features. Their damped counts times inverse
document frequency, scaled to length 1, are compared by cosine with several
centroids per language, found by spherical k-means on a bounded sample. A text
that is farther from every centroid than nearly all of the sample's texts of like
size are from theirs is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import crc32_of, one_thread, own_name, stored, table, tidied

BINS = 1 << 13
BLOCK = 1 << 20
UND = "und"
#: Numbers of n-grams at which the bands of text sizes end; rejection has a limit for each.
BANDS = np.array([32, 128, 512, 2048])
#: Of the low end of a band's cosines, what a text must reach; short texts vary more.
SLACK = (0.3, 0.4, 0.5, 0.5, 0.5)

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    if not _LETTERS:
        codes = np.arange(0x110000, dtype=np.uint32)
        alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _LETTERS.append(np.where(alpha, codes, 0).astype(np.uint32))
    return _LETTERS[0]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the whole text's hashed n-grams; None if it is null or has no letter."""
    if not text:
        return None
    codes = letters()[np.frombuffer(text.lower().encode("utf-32-le"), "<u4")]
    if not codes.any():
        return None
    counts = np.zeros(BINS, np.int64)
    shift = np.uint32(32 - 13)
    for at in range(0, len(codes), BLOCK):
        part = np.concatenate([np.zeros(1, np.uint32) if at == 0 else codes[at - 1 : at], codes[at : at + BLOCK + 1], np.zeros(1 if at + BLOCK >= len(codes) else 0, np.uint32)])
        a, b, c = part[:-2], part[1:-1], part[2:]
        inside = b != 0
        one, two, three = b * np.uint32(2654435761), np.uint32(0), np.uint32(0)
        two = (a * np.uint32(40503) + b) * np.uint32(2246822519) + np.uint32(374761393)
        three = ((a * np.uint32(40503) + b) * np.uint32(40499) + c) * np.uint32(3266489917) + np.uint32(668265263)
        for h in (one, two, three):
            counts += np.bincount((h ^ h >> np.uint32(15))[inside] * np.uint32(2654435769) >> shift, minlength=BINS)
    return counts


def weights(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The normalised TF-IDF values of the n-grams at some places."""
    w = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt((w * w).sum())
    return w / norm if norm else w


def clustered(rows: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Up to k spherical k-means centroids."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        of = (rows @ centres.T).argmax(1)
        sums = np.stack([rows[of == j].sum(0) if (of == j).any() else centres[j] for j in range(len(centres))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        new = sums / np.where(norms, norms, 1)
        if np.allclose(new, centres, atol=1e-5):
            break
        centres = new
    return centres.astype(np.float32)


class LanguageModel:
    """Centroids, their languages, inverse document frequencies, and the rejection limits by language and band."""

    def __init__(self, langs: list[str], counts: list[np.ndarray], per_language: int = 4, seed: int = 7):
        """counts: for each text the places of its n-grams and their counts, as two rows."""
        known, seen = sorted(set(langs)), np.zeros(BINS, np.int64)
        for at, _ in counts:
            seen[at] += 1
        self.idf = (np.log((1 + len(langs)) / (1 + seen)) + 1).astype(np.float32)
        of, names, centres = np.array([known.index(x) for x in langs], int), [], []
        # A band's limit: a part of the low end of what the sample's texts of this band reach.
        self.limits, low = np.zeros((len(known), len(BANDS) + 1)), 0.0
        for k in range(len(known)):  # one language's rows at a time
            own = np.flatnonzero(of == k)
            rows = np.zeros((len(own), BINS), np.float32)
            for row, i in zip(rows, own, strict=True):
                row[counts[i][0]] = weights(*counts[i], self.idf)
            some = clustered(rows, per_language, seed + k)
            centres.append(some)
            names += [k] * len(some)
            near = (rows @ some.T).max(1)
            band = np.searchsorted(BANDS, np.array([counts[i][1].sum() for i in own]) // 3, side="right")
            for b in range(len(BANDS) + 1):
                low = SLACK[b] * float(np.quantile(near[band == b], 0.02)) if (band == b).sum() >= 5 else (low if b else 0.0)
                self.limits[k, b] = low
        self.langs, self.names = known, np.array(names, int)
        self.centres = np.concatenate(centres) if centres else np.zeros((0, BINS), np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The nearest centroid's language, the cosine, and whether it is too far."""
        counts = ngram_counts(text)
        if counts is None or not self.langs:
            return UND, 0.0, True
        at = np.flatnonzero(counts)
        w = weights(at, counts[at], self.idf)
        near = self.centres[:, at] @ w.astype(np.float32)
        best = int(near.argmax())
        k, score = self.names[best], float(np.clip(near[best], 0, 1))
        return self.langs[k], score, score < self.limits[k, np.searchsorted(BANDS, counts.sum() // 3, side="right")]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", *, draw=None, per_label: int = 400, per_language: int = 4, rows: int = 80_000) -> LanguageModel:
    """Fit on at most ``per_label`` rows of each language, and ``rows`` of all (but one of each language at least); rows without a language are not used.

    The order of ``draw`` (by default a hash of the text) chooses the rows. Rows are
    first thinned to about twice that number by draw and the languages' counts, so
    that no language's rows meet in one task; languages of which nothing is left then
    (their rows have one draw) are drawn from their different rows. The driver gets the
    sample's n-gram counts, at most ``BINS`` numbers a row.
    """
    draw = F.xxhash64(text_col) if draw is None else draw
    slim = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), draw.alias("draw")).where("lang is not null and text is not null")
    sizes = stored(slim.groupBy("lang").count(), "languages")
    per_label = max(1, min(per_label, rows // max(1, sizes.count())))
    share = F.least(F.lit(1.0), 2.0 * per_label / F.col("count"))
    thin = slim.join(sizes, "lang").where(F.pmod("draw", F.lit(1_000_003)) < F.ceil(share * 1_000_003))
    drawn = Window.partitionBy("lang").orderBy("draw", "text")
    first = lambda df: df.withColumn("nth", F.row_number().over(drawn)).where(F.col("nth") <= per_label).select("lang", "text")

    @tidied
    def count(batches):
        for batch in batches:
            langs, rows = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (counts := ngram_counts(text.as_py())) is not None:
                    at = np.flatnonzero(counts)
                    langs.append(lang)
                    rows.append(np.concatenate([at, counts[at]]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], names=["lang", "counts"])

    counted = lambda df: df.select("lang", "text").mapInArrow(count, "lang string, counts binary").collect()
    got = counted(first(thin))
    missing = sizes.where(~F.col("lang").isin({r["lang"] for r in got})) if got else sizes
    if not missing.isEmpty():
        got += counted(first(slim.join(missing.select("lang"), "lang", "left_semi").distinct()))
    got = sorted((r["lang"], bytes(r["counts"])) for r in got)
    counts = [np.frombuffer(c, "<i4").reshape(2, -1) for _, c in got]
    with one_thread():
        return LanguageModel([lang for lang, _ in got], counts, per_language)


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """df with the predicted language, its score and whether the text is rejected, under ``names`` (``name_1`` and so on where df has one).

    A text that is null or has no letter is ``und``, 0, rejected; so is every text if
    the model learnt no language. Ties go to the first centroid. Repeated rows and all
    columns stay; an empty table gives an empty result. The model, at
    most (languages x per_language + 1) x BINS floats, travels with the function.
    """
    at, names = df.columns.index(text_col), [own_name(df, x) for x in names]

    @tidied
    def each(batches):
        for batch in batches:
            made = [model.predict(t.as_py()) for t in batch.column(at)]
            new = [pa.array([m[i] for m in made], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return df.mapInArrow(each, T.StructType([*df.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]]))


def held_out(id_col: str = "doc_id"):
    """True for the rows that no model learns from; a null id is one of them."""
    return F.coalesce(crc32_of(F.col(id_col)) % 5 == 0, F.lit(True))


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()), draw=F.xxhash64("doc_id"))
    slim = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(slim, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
