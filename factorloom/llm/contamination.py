"""Benchmark decontamination: SimHash over item-sized windows, DataFrame operations only.

An item's passage is looked for in windows of the item's own number of words. The
fingerprint of a window is a SimHash of 128 bits over its shingles, each weighted by
how often it occurs. Fingerprints are found by multi-index Hamming blocks: eight
blocks of sixteen bits, of which the items' side lists all values up to three flips
away, so any pair within 31 bits agrees on some block: if all blocks differed in four
bits or more, the whole would differ in 32. A pair of unrelated fingerprints meets
in a block with a chance of 8 * 697 / 65536, or 0.085. Passages of similarity 0.8
differ in 19.5 of 128 bits on average, with a standard deviation of 4. Candidates are
then verified by the exact weighted Jaccard similarity of their shingles.

A window of A shingles is as similar to an item of B as s only if s (A + B) / (1 + s)
of its shingles are the item's, wherever they stand. Windows that hold fewer need no
fingerprint and are not formed; all others are: each run of so many shared places that
fits into a window gives every start from which the window covers it. Which of them
match what is decided by fingerprint and verification alone.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

SPACE = " \t\n\x0b\f\r"
RADIUS = 31
BLOCKS, BITS, FLIPS = 8, 16, 3
#: All masks of up to three of sixteen bits.
MASKS = [sum(1 << i for i in some) for n in range(FLIPS + 1) for some in combinations(range(BITS), n)]


def word_hashes(text: Column) -> Column:
    """XXH64 of each word, words being runs of anything but ASCII white space, in lower case; null and blank texts have none."""
    trimmed = F.btrim(F.lower(text), F.lit(SPACE))
    return F.when(trimmed != "", F.transform(F.split(trimmed, "[\\x20\\x09-\\x0D]+"), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def shingle_hashes(words: str, k: int) -> Column:
    """A hash of each run of k words of the column named; words must be a column, not an expression, as each is read k times."""
    w = F.col(words)
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """Bit b is 1 if it is set in over half of the hashes, each counted as often as it occurs."""
    ones = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(shingles, F.lit(0), lambda a, h: a + F.getbit(h, b).cast("int")))
    half = F.size(shingles)
    bits = F.transform(ones, lambda n, b: F.when(n * 2 > half, F.expr("1L")).otherwise(F.lit(0).cast("long")))
    return F.aggregate(F.zip_with(bits, F.sequence(F.lit(0), F.lit(63)), lambda x, b: F.call_function("shiftleft", x, b)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def sized_shingles(words: str, size: str, sizes: list[int]) -> Column:
    """The hashes of the runs of as many words as the column ``size`` tells, one of sizes."""
    return F.coalesce(*[F.when(F.col(size) == k, shingle_hashes(words, k)) for k in sizes])


def wide_simhash(shingles: str) -> list[Column]:
    """Both halves of a SimHash of 128 bits, as ``high`` and ``low``; the second half is of hashes of the hashes."""
    return [simhash(F.col(shingles)).alias("high"), simhash(F.transform(shingles, lambda h: F.xxhash64(h))).alias("low")]


def block_keys(high: Column, low: Column) -> Column:
    """number * 65536 + value of each of the blocks."""
    part = lambda fp, b: F.shiftrightunsigned(fp, BITS * b).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")
    return F.explode(F.array(*[part(fp, b) + ((b + 4 * k) << BITS) for k, fp in enumerate((high, low)) for b in range(4)]))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the shingles' smaller counts over the sum of their larger ones."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda t, x: t + F.least(count(a, x), count(b, x)))
    return both / (F.size(a) + F.size(b) - both).cast("double")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, k: int = 5, least: float = 0.8) -> DataFrame:
    """doc, item, similarity, start, words: the most similar window (the first, in a tie) of each pair with one of ``least`` or more.

    doc and item are the ids; start counts words before the window. An item of
    fewer than k words is one shingle and matches where it stands whole. Items
    without words match nothing, as do documents that are null or empty. Repeated
    rows of a document or item, and null ids, give a row each pair of ids at most.
    A text of any length is read whole. Items join by size: broadcast while small,
    by shuffle beyond that.
    """
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item"), word_hashes(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    items = stored(items.withColumn("size", F.least(F.lit(k), F.size("w"))), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most k
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc long, item long, similarity double, start int, words int")
    known = stored(items.select("item", "size", F.size("w").alias("words"), sized_shingles("w", "size", sizes).alias("shingles")), "item-shingles")
    key = F.xxhash64("doc", "text")
    worded = docs.select(key.alias("key"), word_hashes(F.col("text")).alias("w"))
    places = known.select("words", "size", F.size("shingles").alias("b"), F.xxhash64("shingles").alias("which"), F.explode("shingles").alias("h")).distinct()
    # One reading of the texts gives the shingles of all sizes, one size after the other.
    every = F.concat(*[shingle_hashes("w", s) for s in sizes]) if len(sizes) > 1 else shingle_hashes("w", sizes[0])
    hits = worded.select("key", F.size("w").alias("n"), F.posexplode(every).alias("pos", "h")).join(places, "h")
    for s in sizes[:-1]:
        hits = hits.withColumn("pos", F.when(F.col("size") > s, F.col("pos") - F.greatest(F.lit(0), F.col("n") - s + 1)).otherwise(F.col("pos")))
    hits = hits.where((F.col("pos") >= 0) & (F.col("pos") <= F.col("n") - F.col("size"))).drop("h").distinct()
    held = F.least(F.col("b"), F.col("n") - F.col("size") + 1)
    need = F.ceil(F.lit(least / (1 + least)) * (held + F.col("b")) - 1e-9).cast("int")
    # The places of a run of ``need`` hits: from its first to its last.
    runs = hits.groupBy("key", "n", "words", "size", "b", "which").agg(F.sort_array(F.collect_list("pos")).alias("at")).withColumn("need", need).withColumn("held", held).where(F.size("at") >= F.col("need"))
    ends = F.arrays_zip(F.slice("at", 1, F.size("at") - F.col("need") + 1).alias("first"), F.slice("at", F.col("need"), F.size("at") - F.col("need") + 1).alias("last"))
    runs = runs.select("key", "n", "words", "size", "held", F.explode(ends).alias("run")).where(F.col("run.last") - F.col("run.first") < F.col("held"))
    latest = F.greatest(F.lit(0), F.col("n") - F.col("words"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("run.last") - F.col("held") + 1), F.least(latest, F.col("run.first")))
    windows = stored(runs.select("key", "words", "size", F.explode(starts).alias("start")).distinct(), "windows")
    texts = docs.withColumn("key", key).join(windows.select("key", "size").distinct(), "key").select("key", "doc", "size", word_hashes(F.col("text")).alias("w"))
    texts = stored(texts.select("key", "doc", "size", sized_shingles("w", "size", sizes).alias("shingles")).distinct(), "window-texts")
    cut = F.slice("shingles", F.col("start") + 1, F.greatest(F.lit(1), F.col("words") - F.col("size") + 1))
    cut = windows.join(texts, ["key", "size"]).select("doc", "start", "words", cut.alias("shingles"))
    cut = stored(cut.withColumn("same", F.xxhash64("words", "shingles")), "window-shingles")
    # Copies of a passage are compared once.
    unlike = cut.groupBy("same").agg(F.first("words").alias("words"), F.first("shingles").alias("shingles"))
    prints = stored(unlike.select("same", "words", "shingles", *wide_simhash("shingles")), "window-prints")
    known = stored(known.select("item", "words", "shingles", *wide_simhash("shingles")), "item-prints")
    a = prints.select("same", "words", F.col("high").alias("a1"), F.col("low").alias("a2"), block_keys(F.col("high"), F.col("low")).alias("block"))
    flips = F.expr(f"explode(array({', '.join(map(str, MASKS))}))")
    b = known.select("item", "words", F.col("high").alias("b1"), F.col("low").alias("b2"), block_keys(F.col("high"), F.col("low")).alias("at"))
    b = b.select("item", "words", "b1", "b2", "at", flips.alias("flip")).select("item", "words", "b1", "b2", F.col("at").bitwiseXOR(F.col("flip")).alias("block"))
    near = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2"))) <= RADIUS
    pairs = a.join(b, ["words", "block"]).where(near).select("same", "item", "b1", "b2").distinct()
    pairs = pairs.join(prints.select("same", F.col("shingles").alias("x")), "same")
    known = known.select(F.col("item").alias("item2"), F.col("high").alias("c1"), F.col("low").alias("c2"), F.col("shingles").alias("y")).distinct()
    pairs = pairs.join(known, F.col("item").eqNullSafe(F.col("item2")) & (F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2")))
    alike = pairs.select("same", "item", weighted_similarity(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= least)
    found = cut.select("same", "doc", "start", "words").join(stored(alike, "window-matches"), "same")
    best = F.max_by(F.struct("similarity", "start", "words"), F.struct("similarity", -F.col("start")))
    return found.groupBy("doc", "item").agg(best.alias("best")).select("doc", "item", "best.*")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text has a window like an item. A null id is compared like any other value."""
    bad = stored(contaminated(docs, items, id_col, text_col).select("doc").distinct(), "contaminated")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["doc"]), "left_anti")


def op4_decontamination(spark, sf_dir):
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "similarity", F.col("start").alias("window_start"), F.col("words").alias("window_words"))


OP4_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, string_split_regex(trim(lower(text), E' \t\n\x0b\f\r'), '[\x20\x09-\x0D]+') AS w FROM documents WHERE trim(text, E' \t\n\x0b\f\r') <> ''),
i AS (SELECT DISTINCT item_id, string_split_regex(trim(lower(text), E' \t\n\x0b\f\r'), '[\x20\x09-\x0D]+') AS w FROM benchmark WHERE trim(text, E' \t\n\x0b\f\r') <> ''),
i2 AS (SELECT *, len(w) AS n, least(5, len(w)) AS k FROM i),
ish AS (SELECT item_id, n, k, unnest(range(0, n - k + 1)) AS place, w FROM i2),
ish2 AS (SELECT item_id, n, k, place, array_to_string(w[place + 1 : place + k], ' ') AS s FROM ish),
ks AS (SELECT DISTINCT k FROM i2),
dsh AS (SELECT doc_id, k, len(w) AS m, unnest(range(0, len(w) - k + 1)) AS pos, w FROM d, ks WHERE len(w) >= k),
dsh2 AS (SELECT doc_id, k, m, pos, array_to_string(w[pos + 1 : pos + k], ' ') AS s FROM dsh),
hit AS (SELECT DISTINCT doc_id, item_id, n, k, m, pos FROM dsh2 JOIN ish2 USING (s, k)),
win AS (SELECT DISTINCT doc_id, item_id, n, k, unnest(range(greatest(0, least(pos, pos - (n - k))), least(pos, greatest(0, m - n)) + 1)) AS start FROM hit),
wsh AS (SELECT win.doc_id, win.item_id, win.n, win.k, win.start, s, count(*) AS c FROM win JOIN dsh2 ON win.doc_id = dsh2.doc_id AND win.k = dsh2.k AND pos BETWEEN start AND start + greatest(1, n - win.k + 1) - 1 GROUP BY ALL),
ic AS (SELECT item_id, s, count(*) AS c FROM ish2 GROUP BY ALL),
it AS (SELECT item_id, sum(c) AS t FROM ic GROUP BY ALL),
sim AS (SELECT doc_id, wsh.item_id, n, start, sum(CASE WHEN ic.c IS NULL THEN 0 ELSE least(wsh.c, ic.c) END) AS inter, sum(wsh.c) AS t FROM wsh LEFT JOIN ic ON wsh.item_id = ic.item_id AND wsh.s = ic.s GROUP BY ALL),
good AS (SELECT doc_id, item_id, n, start, inter::DOUBLE / (sim.t + it.t - inter)::DOUBLE AS similarity FROM sim JOIN it USING (item_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM good WHERE similarity >= 0.8)
SELECT doc_id, item_id, similarity, start::INTEGER AS window_start, n::INTEGER AS window_words FROM best WHERE r = 1
"""
