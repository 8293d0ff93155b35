"""SimHash near-duplicate detection with deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that
differ in at most two bits have a segment in which they differ in at most one,
so they agree on one of that segment's 32 one-wildcard variants. Variants are
the equality-join keys, and the whole fingerprints verify each candidate.

Copies are folded before any join: the graph's nodes are distinct fingerprints.
A variant shared by many fingerprints would still give all their pairs, so the
members of a variant with more than ``crowd`` of them go another, equally exact
way: two fingerprints are within two bits of each other if and only if some
64-bit word is within one bit of both. Each member lists its 65 such words, and
every word links its members to their smallest: edges in proportion to members.

``drop_near_duplicates`` goes the same way with longer fingerprints, of sets of shingles:
ten segments, whose one-wildcard variants are the keys. A segment has 24 bits, or as many
more as the number of texts asks for, so that the texts that meet by chance are as many
for each text in a large table as in a small one. Candidates that differ in a quarter of
the bits or fewer are verified on the whole sets. Fingerprints cannot promise every
pair of similarity 0.8, so an exact check follows: pairs that no link connects yet, but that
have one of each set's first shingles in common, in any one order, are verified as well.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, let_go, own_name, small_batches, stored, tidied, tidy_shuffles

SEED = 42
#: ASCII upper case to lower case; every other byte stays.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCK = 1 << 16


def shingle_hashes(text: str | None, k: int) -> list[int]:
    """XXH64 of each k-word shingle, repeats included."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(joined, SEED)]
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends[:-k]]]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)]


def fingerprint(text: str | None, k: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; no words give 0."""
    hashes = shingle_hashes(text, k)
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.array(hashes[at : at + BLOCK], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text_col: str, out: str, k: int = 3) -> DataFrame:
    """df with the fingerprint of each whole text as a long (its two's complement).

    Null and empty texts have fingerprint 0.
    """
    at = df.columns.index(text_col)

    @tidied
    def each(batches):
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py(), k) for t in batch.column(at)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.view("<i8"))], names=[*batch.schema.names, out])

    return df.mapInArrow(each, T.StructType([*df.schema.fields, T.StructField(out, T.LongType(), False)]))


def merged(df: DataFrame) -> DataFrame:
    """df for joins that sort and merge. Its rows grow with the input: as hashes they take many times the size that the planner sees in files, and a broadcast gathers them on the driver."""
    return df.hint("merge")


def _near(a, b, radius: int):
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def sharing(prints: DataFrame, segments: int, bits: int, begin: int = 0) -> DataFrame:
    """(variant, fp, n), stored: the one-wildcard variants of so many segments from ``begin`` on that n > 1 rows of prints (fp, print) have; print is an array of segments of ``bits`` bits."""
    each = f"explode(transform(sequence({begin * bits}, {(begin + segments) * bits - 1}), v -> shiftleft(cast(v as bigint), {bits}) | (print[cast(v div {bits} as int)] & ~shiftleft(1L, v % {bits}))))"
    # Counted with partial sums first, then joined by the planner's own exchange, which splits a crowded variant.
    keyed = prints.select("fp", F.expr(each).alias("variant"))
    sizes = keyed.groupBy("variant").agg(F.count("*").alias("n")).where("n > 1")
    return stored(keyed.join(merged(sizes), "variant"), "simhash-members")


def links(prints: DataFrame, crowd: int = 16) -> DataFrame:
    """Edges (a, b), a < b, over distinct fingerprints ``fp`` whose components are those of the links of 2 or fewer bits."""
    shared = sharing(prints.withColumn("print", F.expr("transform(sequence(0, 1), i -> shiftrightunsigned(fp, 32 * i) & 4294967295L)")), 2, 32)
    pairs = shared.where("n = 2").groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).select("a", "b").where(_near(F.col("a"), F.col("b"), 2))
    few = shared.where(F.col("n").between(3, crowd)).select("variant", "fp")
    x, y = few.alias("x"), few.alias("y")
    some = x.join(merged(y), (F.col("x.variant") == F.col("y.variant")) & (F.col("x.fp") < F.col("y.fp")) & _near(F.col("x.fp"), F.col("y.fp"), 2))
    some = some.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    many = shared.where(F.col("n") > crowd).select("fp").distinct()
    balls = many.select("fp", F.expr("explode(transform(sequence(-1, 63), i -> if(i < 0, fp, fp ^ shiftleft(1L, i))))").alias("word"))
    middles = balls.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("word", "a")
    star = balls.join(merged(middles), "word").where("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(some).unionByName(star).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that it reaches.

    Alternating large-star and small-star steps; each is one aggregation and one
    join, and no neighbour list is ever gathered in one place.
    """
    edges = stored(edges.select("a", "b").where("a <> b"), "components")
    for _ in range(rounds):
        before = edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
        large = both.join(merged(least), both.a == least.u).where("b > a").select(F.col("m").alias("a"), "b").distinct()
        large = stored(large, "large-star")
        # small star: u and its smaller neighbours go to the smallest of them
        discard(least)
        least = stored(large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m"), "least")
        small = large.join(merged(least), large.b == least.u).where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
        edges = stored(small.unionByName(least.select(F.col("m").alias("x"), F.col("u").alias("y"))).distinct().select(F.col("x").alias("a"), F.col("y").alias("b")), "components")
        mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        settled = edges.agg(F.count("*"), mark).first() == before.agg(F.count("*"), mark).first()
        discard(before, large, least)
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def folded_of(prints: DataFrame, id_col: str) -> DataFrame:
    """(fp, first) per distinct ``fp``, stored: first is the smallest (none, id, uid), a null id last."""
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "uid"))
    return stored(prints.groupBy("fp").agg(first.alias("first")), "simhash-folded")


def grouped(folded: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, component_id, keep) per row of folded (fp, first), the edges (a, b) being links of fps.

    component_id is the smallest id reachable by links; keep is the uid of the one
    row that stands for the component: the smallest id, then the smallest uid, a
    null id last.
    """
    roots = components(edges)
    rooted = folded.join(merged(roots.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "simhash-rooted")
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    return stored(rooted.join(merged(best), "root").select("fp", F.col("best.id").alias("component_id"), F.col("best.uid").alias("keep")), "simhash-grouped")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """One row per row of df: id_col, fingerprint (16 hex digits), component_id, is_kept.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows
    stay. An empty table gives an empty result. Columns other than the two named are
    not read. Null ids are kept; a component of null ids only has a null component_id.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = with_fingerprints(slim, "text", "fp", k).select("id", "fp", F.monotonically_increasing_id().alias("uid"))
    prints = stored(prints, "simhash-prints")
    folded = folded_of(prints, "id")
    found = prints.join(merged(grouped(folded, links(folded.select("fp")))), "fp")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("uid") == F.col("keep")).alias("is_kept"))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.array(shingle_hashes(text, k), "<u8"))


#: Fingerprints of sets: segments, the bits of each, and in how many bits of all near copies may differ.
#: Sets of similarity 0.8 differ in 60 of 400 on average, deviation 7.1; unrelated ones in 200.
SEGMENTS, BITS, RADIUS = 10, 40, 100
MIXED = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def key_bits(texts: int) -> int:
    """Of how many bits of each segment the variants are made: a text then meets about one other by chance, however many there are."""
    return min(BITS, max(24, (texts - 1).bit_length() + 8))



def long_print(held: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, in segments: a bit is 1 if it is set in over half of the hashes, each mixed seven ways."""
    counts = np.zeros(64 * (1 + len(MIXED)), np.int64)
    for at in range(0, len(held), BLOCK):
        words = [part := held[at : at + BLOCK]]
        for factor in MIXED:
            words.append((part := (part ^ part >> np.uint64(31)) * np.uint64(factor)) ^ part >> np.uint64(29))
        counts += np.unpackbits(np.stack(words, axis=1).view(np.uint8).reshape(-1, 8 * (1 + len(MIXED))), axis=1).sum(axis=0, dtype=np.int64)
    return (counts[: SEGMENTS * BITS] * 2 > len(held)).reshape(SEGMENTS, BITS) @ (1 << np.arange(BITS))


def with_digests(df: DataFrame, text_col: str, out: str, print_: str, k: int) -> DataFrame:
    """df with a hash of each text's set of shingles and the set's long fingerprint; texts without words have ones of their own."""
    at = df.columns.index(text_col)

    @tidied
    def each(batches):
        let_go()
        for batch in batches:
            made, prints = np.zeros(batch.num_rows, "<u8"), np.zeros((batch.num_rows, SEGMENTS), "<i8")
            for n, t in enumerate(batch.column(at)):
                held = shingle_set(t.as_py(), k)
                made[n], prints[n] = xxhash.xxh64_intdigest(held.tobytes(), SEED), long_print(held)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype="<i4") * SEGMENTS), pa.array(prints.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.view("<i8")), lists], names=[*batch.schema.names, out, print_])

    return df.mapInArrow(each, T.StructType([*df.schema.fields, T.StructField(out, T.LongType(), False), T.StructField(print_, T.ArrayType(T.LongType()))]))


def near_prints(prints: DataFrame, crowd: int = 4, turns: int = 5) -> DataFrame:
    """Candidates (a, b), a < b, among prints (fp, print): they share a variant, and their fingerprints differ in RADIUS bits at most.

    Of a variant that more than ``crowd`` share, only its smallest fp with each other
    one, so that pairs grow with the members and not with the square of a group of
    copies. In turns by segment, so that a part of the variants is shuffled at a time.
    """
    bits, each, met = key_bits(prints.count()), SEGMENTS // turns, []
    keys = prints.select("fp", F.expr(f"transform(print, p -> p & {(1 << bits) - 1}L)").alias("print"))
    for begin in range(0, SEGMENTS, each):
        shared = sharing(keys, each, bits, begin)
        few = shared.where(F.col("n") <= crowd).select("variant", "fp")
        x, y = few.alias("x"), few.alias("y")
        pairs = x.join(merged(y), (F.col("x.variant") == F.col("y.variant")) & (F.col("x.fp") < F.col("y.fp"))).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        many = shared.where(F.col("n") > crowd).select("variant", "fp")
        star = many.join(merged(many.groupBy("variant").agg(F.min("fp").alias("a"))), "variant").where("fp > a").select("a", F.col("fp").alias("b"))
        met.append(stored(pairs.unionByName(star).distinct(), "similar-met"))
        discard(shared)
        tidy_shuffles(prints.sparkSession)
    pairs = reduce(DataFrame.unionByName, met).distinct()
    one = lambda c: merged(prints.select(F.col("fp").alias(c), F.col("print").alias(f"print_{c}")))
    apart = F.expr("aggregate(zip_with(print_a, print_b, (p, q) -> bit_count(p ^ q)), 0, (m, d) -> m + d)")
    out = stored(pairs.join(one("a"), "a").join(one("b"), "b").where(apart <= RADIUS).select("a", "b"), "similar-near")
    discard(*met)
    tidy_shuffles(prints.sparkSession)
    return out


def with_sets(texts: DataFrame, k: int, buckets: np.ndarray | None = None) -> DataFrame:
    """(uid, members) of texts (uid, text): each text's set of shingles, where its uid falls into one of the buckets."""

    @tidied
    def each(batches):
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for at in np.flatnonzero(within(uids, buckets)) if buckets is not None else range(len(uids)):
                held = pa.array(shingle_set(batch.column(1)[int(at)].as_py(), k).view("<i8"))
                yield pa.RecordBatch.from_arrays([pa.array([uids[at]], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)], names=["uid", "members"])

    return texts.select("uid", "text").mapInArrow(each, "uid long, members array<long>")


BUCKETS = 1 << 25
#: Row numbers are a part's number, from bit 33 on, and a place in it: buckets take both.
PLACE, STRIDE = 33, 1_000_003


def within(uids: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Which of uids fall into one of the buckets."""
    at = ((uids & (1 << PLACE) - 1) + (uids >> PLACE) * STRIDE) % BUCKETS
    return buckets[at >> 3] >> (at & 7).astype(np.uint8) & 1


def buckets_of(uids: DataFrame) -> np.ndarray:
    """Which buckets hold a uid: a fixed number of bits, eight in a byte, however many uids there are. What shares a bucket by chance is sorted out by a join."""
    place, part = F.col("uid").bitwiseAND(F.lit((1 << PLACE) - 1).cast("long")), F.shiftright("uid", PLACE)
    found = uids.select(F.pmod(place + part * STRIDE, F.lit(BUCKETS)).cast("int").alias("b")).distinct().toArrow()
    out = np.zeros(BUCKETS, bool)
    out[found.column("b").to_numpy()] = True
    return np.packbits(out, bitorder="little")


def common_shingles(texts: DataFrame, k: int, rows: int = 4000) -> dict[int, int]:
    """Shingles that are in three or more of about ``rows`` drawn texts (copies left aside), and in about how many of all."""
    every = max(1, -(-texts.count() // rows))
    drawn = with_sets(texts.where(F.pmod(F.xxhash64("uid"), F.lit(every)) == 0).dropDuplicates(["fp"]), k)
    return largest(drawn.select(F.explode("members").alias("h")).groupBy("h").agg((F.count("*") * every).alias("m")).where(F.col("m") > 2 * every))


def largest(counts: DataFrame, most: int = 1 << 20) -> dict[int, int]:
    """The ``most`` largest of (h, m)."""
    seen = counts.orderBy(F.desc("m"), "h").limit(most).toArrow()
    return dict(zip(seen.column("h").to_pylist(), seen.column("m").to_pylist(), strict=True))


class Order:
    """An order of all shingles that puts those known to be in many texts last, the most frequent at the end."""

    def __init__(self, known: dict[int, int]):
        common = np.array(list(known), "<i8").view("<u8")
        order = np.argsort(common)
        self.common, self.times = common[order], np.array(list(known.values()), "<i8")[order]

    def first(self, held: np.ndarray, least: float) -> np.ndarray:
        """Of a set the shingles of which one at least is in any set of similarity ``least`` or more, among that one's own."""
        n, rank = len(held), np.zeros(len(held), "<i8")
        if len(self.common):
            place = np.minimum(np.searchsorted(self.common, held), len(self.common) - 1)
            rank = np.where(self.common[place] == held, self.times[place], 0)
        return held[np.lexsort((held, rank))[: n - int(np.ceil(least * n - 1e-9)) + 1]] if n else held


def with_prefixes(texts: DataFrame, k: int, least: float, known: dict[int, int]) -> DataFrame:
    """(fp, h, at, n): the shingles, of n, that come first in an order that is the same for all texts, and their places.

    Sets of similarity ``least`` or more have one of these in common, whatever the
    order. Here the shingles ``known`` to be in many texts come last, which spares
    pairs and decides nothing. Copies that one task meets give their rows once.
    """
    order = Order(known)

    @tidied
    def each(batches):
        done: set[int] = set()
        for batch in batches:
            fps, new = batch.column(0).to_pylist(), []
            for at, fp in enumerate(fps):
                if fp not in done:
                    done.add(fp)
                    new.append(at)
            sets = [shingle_set(batch.column(1)[at].as_py(), k) for at in new]
            made = [order.first(held, least) for held in sets]
            counts = [len(h) for h in made]
            if not sum(counts):
                continue
            columns = [
                np.repeat(np.array([fps[at] for at in new], "<i8"), counts),
                np.concatenate(made).view("<i8"),
                np.concatenate([np.arange(c, dtype="<i4") for c in counts]),
                np.repeat(np.array([len(held) for held in sets], "<i4"), counts),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fp", "h", "at", "n"])

    return texts.select("fp", "text").mapInArrow(each, "fp long, h long, at int, n int")


def members_of(texts: DataFrame, k: int, least: float, crowd: int = 32, turns: int = 4) -> DataFrame:
    """(h, fp, at, n), stored: the texts' first shingles that two different texts or more have.

    A first shingle with more than ``crowd`` members is common after all: it is put
    behind the rarer ones, and all texts' first shingles are taken anew in that order.
    What stays crowded are the shingles of large groups of near copies and of texts
    that have no rarer ones. On the driver are at most 1,048,576 shingles.
    """
    spark, several = texts.sparkSession, F.min("fp") != F.max("fp")
    known = common_shingles(texts, k)
    sizes = with_prefixes(texts, k, least, known).groupBy("h").agg(several.alias("several"), F.count("*").alias("m"))
    sizes = stored(sizes.where(F.col("several") & (F.col("m") > crowd)).select("h", "m"), "similar-crowded")
    order = {**known, **{h: max(m, known.get(h, 0)) for h, m in largest(sizes).items()}}
    discard(sizes)
    tidy_shuffles(spark)
    keyed = stored(with_prefixes(texts, k, least, order), "similar-prefixes")
    # In turns by shingle, so that a part of the rows is shuffled at a time.
    parts = []
    for turn in range(turns):
        own = keyed.where(F.pmod("h", F.lit(turns)) == turn)
        shared = own.groupBy("h").agg(several.alias("several")).where("several").select("h")
        parts.append(stored(own.join(merged(shared), "h").groupBy("h", "fp", "n").agg(F.min("at").alias("at")), "similar-part"))
        tidy_shuffles(spark)
    discard(keyed)
    out = stored(reduce(DataFrame.unionByName, parts), "similar-members")
    discard(*parts)
    return out


def similar(texts: DataFrame, ones: DataFrame, prints: DataFrame, k: int, least: float) -> DataFrame:
    """Edges (a, b) over the fp of texts (fp, text, uid), whose components are those of all pairs with Jaccard similarity ``least`` or more; ones (fp, uid): a row of each fp; prints (fp, print).

    SimHash finds candidates by the variants of their fingerprints, and each is
    verified on the whole sets. An exact check follows for what fingerprints cannot
    promise: all pairs that these edges do not connect yet and that have a first shingle
    in common which can be the first that both have: of sets of x and y shingles,
    i = least (x + y) / (1 + least) must be in both, so no more than x - i and y - i
    come before it. A pair is a candidate there only if it has so many first shingles in
    common as its sizes ask for: all but x - i of the first ones of one and y - i of
    the other. Each edge is verified on the whole sets.
    """

    def verified(pairs):
        """Edges among the pairs (a, b), stored."""
        wanted = stored(pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct().join(merged(ones), "fp"), "similar-wanted")
        sets = stored(with_sets(texts, k, buckets_of(wanted)).join(merged(wanted), "uid").select("fp", "members"), "similar-sets")
        left, right = sets.select(F.col("fp").alias("a"), F.col("members").alias("x")), sets.select(F.col("fp").alias("b"), F.col("members").alias("y"))
        inside = F.size(F.array_intersect("x", "y"))
        edges = stored(pairs.join(merged(left), "a").join(merged(right), "b").where(inside / (F.size("x") + F.size("y") - inside) >= least).select("a", "b"), "similar-edges")
        discard(pairs, wanted, sets)
        tidy_shuffles(texts.sparkSession)
        return edges

    edges = verified(near_prints(prints))
    roots = components(edges).withColumnRenamed("node", "fp")
    shared = members_of(texts, k, least)
    some = lambda n: F.ceil(F.lit(least) * n - 1e-9)
    both = lambda x, y: F.ceil(F.lit(least / (1 + least)) * (F.col(x) + F.col(y)) - 1e-9)
    enough = F.col("c") >= F.least(both("nx", "ny") - some(F.col("nx")), both("nx", "ny") - some(F.col("ny"))) + 1
    mine = lambda x, n: merged(shared.select("h", F.col("fp").alias(x), F.col("n").alias(n)))
    rooted = shared.join(merged(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted, "similar-rooted")
    mixed = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    mixed = stored(rooted.join(merged(mixed), "h", "left_semi"), "similar-mixed")
    one = lambda x: merged(mixed.select("h", F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at_{x}"), F.col("root").alias(f"root_{x}")))
    apart = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & (F.col("at_a") <= F.col("na") - both("na", "nb")) & (F.col("at_b") <= F.col("nb") - both("na", "nb"))
    rest = stored(one("a").join(one("b"), "h").where(apart).select("a", "b").distinct(), "similar-rest")
    discard(rooted, mixed)
    # A pair's shingles need not all lead to it, so they are counted from both texts' own.
    counted = rest.join(mine("a", "nx"), "a").join(mine("b", "ny"), ["b", "h"]).groupBy("a", "b", "nx", "ny").agg(F.count("*").alias("c"))
    out = stored(edges.unionByName(verified(stored(counted.where(enough).select("a", "b"), "similar-pairs"))), "similar-links")
    discard(shared, rest)
    return out


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: float = 0.8) -> DataFrame:
    """df with exactly one row of each group of near duplicates: the smallest id, or one of its repeated rows.

    Two rows are linked if the Jaccard similarity of their sets of k-word shingles is
    ``least`` or more; no such pair is missed. Texts without words link with each
    other. All columns of df come back, whatever their names.
    """
    fp, uid, print_ = own_name(df, "fp"), own_name(df, "uid"), own_name(df, "print")
    with small_batches(df.sparkSession):
        marked = stored(with_digests(df, text_col, fp, print_, k).withColumn(uid, F.monotonically_increasing_id()), "simhash-rows")
        folded = folded_of(marked.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(uid).alias("uid")), "id")
        ones = folded.select("fp", F.col("first.uid").alias("uid"))
        prints = stored(marked.select(F.col(uid).alias("uid"), F.col(print_).alias("print")).join(merged(ones), "uid").select("fp", "print"), "similar-prints")
        texts = marked.select(F.col(fp).alias("fp"), F.col(text_col).alias("text"), F.col(uid).alias("uid"))
        keep = grouped(folded, similar(texts, ones, prints, k, least)).select(F.col("keep").alias(uid)).distinct()
    return marked.join(merged(keep), uid, "left_semi").select(*df.columns)


def op1_simhash_dedup(spark, sf_dir):
    from .common import table

    return simhash_components(table(spark, sf_dir, "documents"))
