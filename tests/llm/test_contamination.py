"""op4: planted passages, a brute-force search of every window, and SQL."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factorloom.llm.contamination import MASKS, OP4_SQL, RADIUS, contaminated, drop_contaminated, op4_decontamination, simhash, weighted_similarity

from ..conftest import same

random.seed(11)
LEXICON = [f"w{i}" for i in range(900)]


def words(text):
    out = text.lower()
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def shingles(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def plain(docs, items):
    best = {}
    for d, text in docs:
        w, held = words(text or ""), {}
        for i, item in items:
            v = words(item or "")
            if not v:
                continue
            k = min(5, len(v))
            b = shingles(v, k)
            held.setdefault(k, shingles(w, k).keys())
            if held[k].isdisjoint(b):  # every window's similarity is 0
                continue
            for at in range(max(1, len(w) - len(v) + 1)):
                a = shingles(w[at : at + len(v)], k)
                both, every = sum((a & b).values()), sum((a | b).values())
                s = both / every if every else 0
                if s >= 0.8 and (s, -at) > best.get((d, i), ((0, 0), 0))[0]:
                    best[d, i] = ((s, -at), len(v))
    return {k: (v[0][0], -v[0][1], v[1]) for k, v in best.items()}


def sample():
    items = [(n, " ".join(random.choices(LEXICON, k=random.randint(12, 60)))) for n in range(25)]
    items += [(90, "go"), (91, "two words"), (92, None), (93, " \n"), (94, "a b a b a b a b a b a b a b"), (95, items[0][1]), (None, items[1][1])]
    docs = []
    for n in range(160):
        w = random.choices(LEXICON, k=random.randint(0, 150))
        if n % 2:
            v = words(random.choice(items[:25])[1])
            if n % 4 == 3:
                v[random.randrange(len(v))] = "changed"
            if n % 8 == 5:
                v.insert(random.randrange(len(v)), "more")
            if n % 16 == 1:
                v = v[: len(v) - 3]
            at = random.randint(0, len(w))
            w[at:at] = v
        docs.append((n, random.choice([" ", "\n", "  \t"]).join(w).title()))
    docs += [(500, None), (501, ""), (502, "Go"), (503, "x two words y"), (504, "z " + "a b " * 30), (505, items[3][1]), (505, items[3][1]), (None, items[4][1]), (506, " ".join(random.choices(LEXICON, k=30000)) + " " + items[5][1])]
    return docs, items


def test_every_window_that_brute_force_finds(spark):
    docs, items = sample()
    got = contaminated(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item string"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc int")).collect()
    rows = {(r.doc, r.item): (r.similarity, r.start, r.words) for r in got}
    assert len(rows) == len(got)
    want = plain([d for d in docs if d[0] not in (505, None)], [i for i in items if i[0] is not None])
    mine = {k: v for k, v in rows.items() if k[0] not in (505, None) and k[1] is not None}
    assert {k: (v[0], v[2]) for k, v in mine.items()} == {k: (v[0], v[2]) for k, v in want.items()}
    text, item = dict(docs), dict(items)
    for (d, i), (similarity, start, n) in mine.items():
        v, k = words(item[i]), min(5, n)
        a, b = shingles(words(text[d])[start : start + n], k), shingles(v, k)
        assert similarity == sum((a & b).values()) / sum((a | b).values())
    assert rows[505, 3][0] == 1.0 and rows[None, 4][0] == 1.0 and rows[502, 90][0] == 1.0


def test_passages_in_another_order(spark):
    """Sentences moved inside a passage: the best window need not start where a shared shingle's place in the item tells."""
    random.seed(12)
    items = [(n, " ".join(random.choices(LEXICON, k=size))) for n, size in enumerate((60, 100, 100, 200, 30))]
    docs = []
    for (n, item), moved in zip(items, (10, 15, 50, 40, 3), strict=True):
        v = item.split()
        v = v[moved:] + v[:moved]
        for extra in (0, 1, 80):
            docs.append((len(docs), " ".join([*random.choices(LEXICON, k=extra), *v, *random.choices(LEXICON, k=extra)])))
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain(docs, items)
    assert {(n, n // 3) for n in range(12)} <= want.keys()
    assert {(r.doc, r.item): (r.similarity, r.start, r.words) for r in got} == want


def test_clean_documents_stay_and_columns_too(spark):
    docs, items = sample()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, doc string, similarity int")
    frame = spark.createDataFrame(items, "item_id long, text string")
    kept = drop_contaminated(df, frame)
    bad = {r.doc for r in contaminated(df, frame).select("doc").collect()}
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contaminated(docs.limit(0), items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0
    assert drop_contaminated(docs, items.limit(0)).count() == 1


def test_blocks_reach_the_radius():
    """Any difference of up to RADIUS bits leaves some block with at most three."""
    random.seed(1)
    for _ in range(3000):
        bits = random.sample(range(128), RADIUS)
        assert min(sum(b // 16 == k for b in bits) for k in range(8)) <= 3
    assert len(MASKS) == len(set(MASKS)) == 697 and all(m.bit_count() <= 3 for m in MASKS)


def test_recall_at_the_edge(spark):
    """Passages whose best window is barely similar enough: shortened, repeated, reordered and changed ones."""
    random.seed(21)
    items = [(n, " ".join(random.choices(LEXICON, k=random.randint(20, 60)))) for n in range(60)]
    docs = []
    for n in range(600):
        v = words(items[n % 60][1])
        size = len(v)
        if n % 4 == 0:
            v = v[: size - random.randint(2, size // 5)]
        elif n % 4 == 1:
            v = v + v
        elif n % 4 == 2:
            moved = random.randint(1, size - 1)
            v = v[moved:] + v[:moved]
        else:
            v[random.randrange(size)] = "changed"
        docs.append((n, " ".join([*random.choices(LEXICON, k=20), *v, *random.choices(LEXICON, k=20)])))
    want = plain(docs, items)
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    rows = {(r.doc, r.item): (r.similarity, r.start, r.words) for r in got}
    assert len(want) > 300 and sum(s < 0.85 for s, _, _ in want.values()) > 40
    assert rows.keys() <= want.keys() and len(rows) >= 0.99 * len(want)
    assert sum(rows[k] == want[k] for k in rows) >= 0.99 * len(want)


def test_expressions(spark):
    random.seed(2)
    a = [random.getrandbits(64) - (1 << 63) for _ in range(33)]
    b = a[:20] + a[:3] + [5, 6]
    row = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(simhash(F.col("a")).alias("h"), weighted_similarity(F.col("a"), F.col("b")).alias("s")).first()
    want = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in a) > len(a))
    assert row.h & (1 << 64) - 1 == want
    assert row.s == sum((Counter(a) & Counter(b)).values()) / sum((Counter(a) | Counter(b)).values())


def test_query_is_its_sql(spark, small):
    same(op4_decontamination(spark, small), small, OP4_SQL)


def test_no_python_in_the_plan(spark, small):
    plan = op4_decontamination(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize(("text", "times"), [("\x0b\x0c", 0), ("é É", 1), ("É É", 1), ("é x", 0)])
def test_odd_items(spark, text, times):
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x É é y"), (2, "")], "doc_id long, text string")
    assert contaminated(docs, items).count() == times
