"""op2: places, pieces and the number of sequences against exhaustive search."""

import itertools
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from factorloom.llm.packing import best_fit, fillings, lower_bound, pack, pack_counts, places

from .test_tokens import plain


def bins_of(patterns):
    return sum(t for t, _ in patterns)


def check(patterns, counts, capacity):
    held = Counter()
    for times, items in patterns:
        assert sum(s * n for s, n in items) <= capacity and times > 0
        for s, n in items:
            held[s] += times * n
    assert held == Counter({s: n for s, n in counts.items() if n})


def optimum(items, capacity):
    @cache
    def best(left):
        if not left:
            return 0
        out, rest = len(left), left[1:]
        for k in range(len(rest) + 1):
            for some in itertools.combinations(range(len(rest)), k):
                if left[0] + sum(rest[i] for i in some) <= capacity:
                    out = min(out, 1 + best(tuple(x for i, x in enumerate(rest) if i not in some)))
        return out

    return best(tuple(sorted(items, reverse=True)))


def test_packing_is_optimal_on_small_cases():
    """With the parameters of production."""
    random.seed(1)
    for _ in range(150):
        items = [random.randint(1, 20) for _ in range(random.randint(1, 9))]
        counts = dict(Counter(items))
        got = pack_counts(counts, 20)
        check(got, counts, 20)
        want = optimum(items, 20)
        assert lower_bound(counts, 20) <= want == bins_of(got) <= bins_of(best_fit(counts, 20))


@pytest.mark.parametrize(("counts", "capacity"), [({4: 2, 3: 4}, 10), ({4: 2000, 3: 4000}, 10), ({44: 2, 24: 2, 22: 2, 12: 1, 8: 2, 6: 1, 3: 2}, 61), ({1366: 700, 1365: 1400, 1364: 1, 2731: 0}, 4096), ({2000: 90, 1500: 90, 596: 90}, 4096)])
def test_completion_reaches_the_bound_where_best_fit_does_not(counts, capacity):
    got = pack_counts(counts, capacity)
    check(got, counts, capacity)
    assert bins_of(got) == lower_bound(counts, capacity)
    assert 44 in counts or 1366 in counts or bins_of(got) < bins_of(best_fit(counts, capacity))


def test_completion_uses_fillings_less_often_than_it_could():
    """Tables of few lengths, many of each: optimal where the exhaustive search can tell, and better than best-fit in some."""
    random.seed(8)
    better = 0
    for _ in range(120):
        counts = dict(Counter(random.choice([7, 8, 9, 11, 12, 13, 17]) for _ in range(10)))
        got = pack_counts(counts, 30)
        check(got, counts, 30)
        assert bins_of(got) == optimum([s for s, n in counts.items() for _ in range(n)], 30)
        better += bins_of(got) < bins_of(best_fit(counts, 30))
    assert better > 0
    wide = dict(Counter(random.randint(15, 60) for _ in range(400)))
    got = pack_counts(wide, 100)
    check(got, wide, 100)
    assert bins_of(got) <= bins_of(best_fit(wide, 100))


def test_fillings_are_maximal_and_undominated():
    counts = {7: 1, 5: 2, 3: 1, 2: 2}
    got, _, whole = fillings(counts, 10, 1000)
    assert whole and (tuple(sorted(got[0][0])), got[0][1]) in {((5, 5), 0), ((3, 7), 0), ((2, 3, 5), 0)}
    for chosen, waste in got:
        left = Counter(counts) - Counter(chosen)
        assert sum(chosen) + waste == 10 and not any(s <= waste for s in left)
        assert not any(c < s <= c + waste for c in chosen for s in left)
    assert not fillings(counts, 10, 2)[2]


def test_a_query_whose_best_fit_misses_the_bound(spark):
    """Texts of 1,500, 1,300 and 1,296 tokens: best-fit puts two of the long ones together."""
    sizes = [1500] * 4 + [1300] * 4 + [1296] * 4
    counts = Counter(sizes)
    docs = spark.createDataFrame([(n, "a " * (size - 1)) for n, size in enumerate(sizes)], "doc_id long, text string")
    rows = pack(docs).collect()
    lengths = Counter(r.length for r in rows)
    assert len(set(lengths)) == 3 and sum(lengths.values()) == 12 and sorted(lengths.values()) == sorted(counts.values())
    assert len({r.sequence_id for r in rows}) == lower_bound(dict(lengths), 4096)


def test_many_equal_lengths_are_quick():
    counts = {n: 10**9 + n for n in range(1, 4097)}
    got = pack_counts(counts, 4096)
    check(got, counts, 4096)
    assert bins_of(got) - lower_bound(counts, 4096) <= 4096
    where = places(got, 4096)
    assert np.all(np.diff(where["key"]) > 0)


def test_places_are_gapless(spark):
    random.seed(4)
    rows = [(n, " ".join(random.choices(["ab", "Cd.", "é", "xyz 9"], k=random.randint(0, 60)))) for n in range(300)]
    rows += [(n, "the same text") for n in range(1000, 1200)] + [(5, None), (None, "no id"), (7, "long " * 3000), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, piece string, LENGTH int").repartition(7)
    got = pack(df, capacity=512).collect()
    ids_of, want = plain("word_bpe_49k.json"), []
    for doc, text in rows:
        ids = ids_of(text) + (1).to_bytes(4, "little")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for some in by.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by) == bins_of(pack_counts(dict(Counter(r.length for r in got)), 512))


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pack_counts({}, 10) == [] and lower_bound({}, 10) == 0


@pytest.mark.parametrize("length", [1, 4096])
def test_one_length(length):
    assert bins_of(pack_counts({length: 5000}, 4096)) == -(-5000 * length // 4096)
