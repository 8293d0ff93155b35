"""Best-fit packing of token sequences by bin completion.

What must be packed is a multiset of lengths of at most ``capacity``, so however
many documents there are, the packing problem is a table of at most ``capacity``
counts. The driver solves that bounded problem for patterns (a filling and how
often it is used); executors then give every piece its place from its length and
its rank among the pieces of that length. No list of documents leaves them.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import own_name, stored, table, tidied
from .tokens import encoder

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # times, ((length, how many), ...)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Least number of bins: all lengths' sum, or large ones that exclude each other and what must go beside them.

    For each length t of up to half the capacity: lengths over capacity - t need bins
    of their own, those over half need one each, and those from t to half go into
    what the latter leave free.
    """
    if not counts:
        return 0
    sizes = np.array(sorted(counts), np.int64)
    many = np.array([counts[int(s)] for s in sizes], np.int64)
    number, total = (np.concatenate([[0], np.cumsum(x)]) for x in (many, many * sizes))
    half = int(np.searchsorted(sizes, capacity // 2, side="right"))
    large = int(number[-1] - number[half])
    best = max(large, -(-int(total[-1]) // capacity))
    if half:
        least = np.arange(half)
        alone = np.maximum(half, np.searchsorted(sizes, capacity - sizes[:half], side="right"))
        free = (number[alone] - number[half]) * capacity - (total[alone] - total[half])
        best = max(best, int((large + np.maximum(0, -(-(total[half] - total[least] - free) // capacity))).max()))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing; equal bins are handled together."""
    rooms: list[int] = []  # sorted free spaces that open bins have
    open_: dict[int, list[list]] = {}  # by free space: [times, items]

    def put(room: int, times: int, items: tuple) -> None:
        if times:
            if room not in open_:
                rooms.insert(bisect_left(rooms, room), room)
                open_[room] = []
            open_[room].append([times, items])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                each = min(capacity // size, left)
                put(capacity - each * size, left // each, ((size, each),))
                left -= left // each * each
                continue
            room = rooms[k]
            group = open_[room]
            times, items = group[-1]
            each = min(room // size, left)
            used = min(times, left // each)
            if used == times:
                group.pop()
            else:
                group[-1][0] -= used
            if not group:
                del open_[room], rooms[k]
            put(room - each * size, used, (*items, (size, each)))
            left -= used * each
    return [(times, items) for group in open_.values() for times, items in group]


def fillings(counts: dict[int, int], room: int, steps: int) -> tuple[list[tuple[tuple[int, ...], int]], int, bool]:
    """Undominated fillings of room from what counts holds, least waste first, as (lengths, waste); the steps taken; whether these are all.

    A filling is dropped if another length left over would still fit (it is not
    maximal) or if one of its lengths can be exchanged for a longer one left over
    that fits: the exchanged filling dominates it. ``steps`` bounds the search.
    """
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    negative = [-s for s in sizes]
    found: dict[tuple[int, ...], int] = {}
    budget = [steps]

    def spare(size: int, chosen: tuple[int, ...]) -> bool:
        return counts.get(size, 0) > chosen.count(size)

    def undominated(chosen: tuple[int, ...], waste: int) -> bool:
        if any(spare(s, chosen) for s in sizes[bisect_left(negative, -waste) :]):
            return False
        return not any(spare(s, chosen) for c in set(chosen) for s in sizes[bisect_left(negative, -(c + waste)) : bisect_left(negative, -c)])

    def search(k: int, chosen: tuple[int, ...], left: int) -> None:
        budget[0] -= 1
        if spare(left, chosen):
            found[(*chosen, left)] = 0
        k, grown = max(k, bisect_left(negative, -left)), False
        while k < len(sizes) and budget[0] > 0:
            if spare(sizes[k], chosen):
                grown = True
                search(k, (*chosen, sizes[k]), left - sizes[k])
            k += 1
        if not grown and budget[0] > 0 and undominated(chosen, left):
            found[chosen] = left

    search(0, (), room)
    search = None  # a function that refers to itself would keep all this until the garbage is collected
    if not found:  # the budget ended first: fill greedily, which is maximal
        chosen, left = [], room
        for size in sizes:
            each = min(left // size, counts[size])
            chosen += [size] * each
            left -= each * size
        found[tuple(chosen)] = left
    return sorted(found.items(), key=lambda x: (x[1], len(x[0]), x[0])), steps - budget[0], budget[0] > 0


def pack_counts(counts: dict[int, int], capacity: int, *, work: int = 1_000_000, steps: int = 2000) -> list[Pattern]:
    """Patterns that hold each length as often as counts says, in as few bins as found.

    Best-fit decreasing is the first incumbent; if it meets the lower bound it is
    optimal. Else bin completion: take the largest length left, branch over the
    undominated fillings around it, each used as often as the counts allow, half as
    often, and so on down to once, and leave a branch as soon as its waste exceeds what
    a better packing may waste. In every node best-fit completes the rest, which may
    become the incumbent. The tree is searched by limited discrepancy: first the branch
    that looks best in every node, then all that turn aside from it by one place in
    all, by two, and so on; so the search goes back to its first decisions early, and
    ends when a whole tree has been seen. ``work`` bounds all this on the driver, in
    lengths looked at, and ``steps`` the fillings tried in a node: beyond them the best
    incumbent is the answer.
    """
    left = {s: n for s, n in counts.items() if n}
    bins = lambda patterns: sum(t for t, _ in patterns)
    total, least, best = sum(s * n for s, n in left.items()), lower_bound(left, capacity), best_fit(left, capacity)
    most = bins(best)

    def take(items: dict[int, int], times: int) -> None:
        for s, k in items.items():
            left[s] = left.get(s, 0) - times * k
            if not left[s]:
                del left[s]

    def children(waste: int):
        """(lengths, times, waste) around the largest length left, the likeliest first; also the work, and whether these are all."""
        largest = max(left)
        take({largest: 1}, 1)
        around, tried, whole = fillings(left, capacity - largest, steps)
        take({largest: 1}, -1)
        out = []
        for chosen, spare in around:
            items: dict[int, int] = {largest: 1}
            for s in chosen:
                items[s] = items.get(s, 0) + 1
            times = min(left[s] // k for s, k in items.items())
            for halved in range(times.bit_length()):
                if waste + (times >> halved) * spare <= (most - 1) * capacity - total:
                    out.append((halved, items, times >> halved, spare))
        out.sort(key=lambda x: x[0])
        return [x[1:] for x in out], tried, whole

    turned, whole = 0, False
    while most > least and work > 0 and not whole:
        # One pass: all leaves that turn aside by ``turned`` places in all. A frame: what took us there, its children, how far aside.
        whole, done, stack = True, [], []
        used = waste = 0
        entering: tuple | None = ({}, 0, 0, turned)
        while (entering or stack) and most > least and work > 0:
            if entering:
                items, times, spare, may = entering
                take(items, times)
                used, waste, entering = used + times, waste + times * spare, None
                if times:
                    done.append((times, tuple(items.items())))
                rest = best_fit(left, capacity)
                work -= 20 + len(left)
                if used + bins(rest) < most:
                    best, most = [*done, *rest], used + bins(rest)
                rest = None  # not to be held while the branches are searched
                some: list = []
                if left and used + lower_bound(left, capacity) < most:
                    some, tried, every = children(waste)
                    work -= tried
                    if not every or len(some) > may + 1:
                        whole = False
                stack.append((items, times, spare, iter(enumerate(some[: may + 1])), may))
                continue
            items, times, spare, some, may = stack[-1]
            step = next(some, None)
            if step is not None:
                place, (more, often, loss) = step
                entering = (more, often, loss, may - place)
                continue
            stack.pop()
            if times:
                done.pop()
            take(items, -times)
            used, waste = used - times, waste - times * spare
        while stack:
            items, times, *_ = stack.pop()
            take(items, -times)
        turned = 2 * turned + 1
    return best


def places(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """Where the piece of a length and rank goes: rows sorted by length, then first rank.

    There are at most as many rows as patterns have items: bounded by the capacity, not by the data.
    """
    rows, seen, base = [], {}, 0
    for times, items in patterns:
        offset = 0
        for size, each in items:
            first = seen.get(size, 0)
            rows.append((size, first, base, each, offset))
            seen[size] = first + times * each
            offset += size * each
        base += times
    rows.sort()
    table_ = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": table_[:, 0] * (1 << 48) + table_[:, 1], "first": table_[:, 1], "base": table_[:, 2], "each": table_[:, 3], "offset": table_[:, 4]}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, tokenizer: str, path: str | None) -> DataFrame:
    """A row per piece."""
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    @tidied
    def cut(batches):
        words = encoder(tokenizer, path, False)
        end = np.array([end_id], "<u4").tobytes()
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode_each(batch.column(1)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return slim.mapInArrow(cut, PIECES)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 4096, end_id: int = 1, tokenizer: str = "word_bpe_49k.json", path: str | None = None) -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: one piece that is the end id alone. Documents over the
    capacity are cut; repeated rows and null ids are packed like others; an empty
    table gives an empty result. Columns other than the two named are not read.
    """
    pieces = stored(cut_pieces(df, id_col, text_col, capacity, end_id, tokenizer, path), "pieces")
    # In ranges of lengths a piece's rank is its place among its length's in its part, and how many lie in the parts before.
    sorted_ = pieces.repartitionByRange("length", F.xxhash64("doc_id", "piece")).sortWithinPartitions("length")
    sorted_ = stored(sorted_.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "ranked-pieces")
    counts = stored(sorted_.groupBy("part", "length").agg(F.count("*").alias("n"), F.min("at").alias("begin")), "piece-counts")  # at most capacity + parts rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("begin")).alias("first"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}  # at most capacity rows
    where = places(pack_counts(totals, capacity), capacity)

    @tidied
    def place(batches):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(where["key"], size * (1 << 48) + rank, side="right") - 1
            nth, each = rank - where["first"][at], where["each"][at]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(where["base"][at] + nth // each), pa.array(where["offset"][at] + nth % each * size)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = sorted_.join(firsts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("at") + F.col("first")).cast("long").alias("rank"))
    out = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", own_name(out.drop("doc_id"), id_col))


def op2_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
