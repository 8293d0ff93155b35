"""op1 against brute force."""

import random
from collections import defaultdict

import xxhash

from factorloom.llm.simhash import components, drop_near_duplicates, fingerprint, links, simhash_components

random.seed(3)
WORDS = [f"w{i}" for i in range(400)]


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            groups[find(i)].append(k)
    return sorted(((k, f"{p:016x}", min(groups[find(i)], default=None)) for i, ((k, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def texts():
    base = [" ".join(random.choices(WORDS, k=random.randint(1, 300))) for _ in range(60)]
    rows = list(base)
    for t in base[:30]:
        for _ in range(3):
            w = t.split()
            w[random.randrange(len(w))] = random.choice(WORDS)
            rows.append("\t".join(w).upper())
    return [*rows, None, "", " \n ", "one", "ONE", "one two", "é ß", "É ß", *[base[0]] * 5, " ".join(random.choices(WORDS, k=20000))]


def test_components_match_brute_force(spark):
    rows = [(n * 3, t) for n, t in enumerate(texts())]
    rows += [(None, rows[0][1]), (None, "alone and without id"), rows[4], rows[4]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = simhash_components(df)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=str) == plain_components(rows)


def test_crowded_variants_lose_no_link(spark):
    """A chain and a cloud of fingerprints around one word, and far ones: the crowd's way and the pairs' way agree with brute force."""
    random.seed(5)
    centre = random.getrandbits(64)
    prints = {centre ^ (1 << i) for i in range(64)} | {centre ^ (1 << i) ^ (1 << j) ^ (1 << k) for i, j, k in (random.sample(range(64), 3) for _ in range(150))}
    prints |= {random.getrandbits(64) for _ in range(50)} | {0, 3, 12, 15, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {}
    for crowd in (2, 16, 10**6):
        edges = links(df, crowd)
        assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 2 for r in edges.collect())
        roots = {r.node: r.root for r in components(edges).collect()}
        want[crowd] = {p: roots.get(p, p) for p in signed}
    adjacent = defaultdict(set)
    for a in signed:
        for b in signed:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                adjacent[a].add(b)
    plain = {}
    for p in sorted(signed):
        if p not in plain:
            todo = [p]
            while todo:
                x = todo.pop()
                if x not in plain:
                    plain[x] = p
                    todo += adjacent[x]
    assert want[2] == want[16] == want[10**6] == plain


def test_long_chains_settle(spark):
    chain = spark.range(0, 300).selectExpr("id as a", "id + 1 as b")
    assert {(r.node, r.root) for r in components(chain).collect()} == {(n, 0) for n in range(301)}


def test_one_of_each_group_stays_with_all_columns(spark):
    rows = [(2, "a b c d", "x", 1), (1, "A B C D", "y", 2), (1, "A B C D", "y", 2), (3, "other words here now", None, 3), (None, None, None, None), (9, "", "e", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, UID int")
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "A B C D", "y", 2), (3, "other words here now", None, 3), (9, "", "e", 4)], key=str)


def test_all_similar_texts_are_linked(spark):
    """Near copies of a few changed words each, chains and a crowd of them, against the Jaccard similarity of all pairs."""
    random.seed(8)
    rows = []
    for n in range(40):
        w = random.choices(WORDS, k=random.choice([6, 40, 300]))
        for changed in (0, 1, 2, 3, 5, len(w) // 20):
            v = list(w)
            for at in random.sample(range(len(v)), changed):
                v[at] = f"new{random.randrange(10**6)}"
            rows.append(" ".join(v))
    w = random.choices(WORDS, k=200)
    for _ in range(60):
        v = list(w)
        for at in random.sample(range(200), 4):
            v[at] = f"new{random.randrange(10**6)}"
        rows.append(" ".join(v))
    for _ in range(12):
        w = [*w, *random.choices(WORDS, k=30)]
        rows.append(" ".join(w))
    rows += ["", " ", None, "one", "One", "one two"]
    random.shuffle(rows)
    sets = []
    for t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    want = {find(i) for i in range(len(rows))}
    assert 60 < len(want) < len(rows) - 50
    assert {r.doc_id for r in drop_near_duplicates(df).collect()} == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(df).count() == 0 and drop_near_duplicates(df).count() == 0


def test_fingerprint_of_few_words():
    assert fingerprint(None) == fingerprint("  ") == 0
    assert fingerprint("one two") == xxhash.xxh64_intdigest("one two", 42)


def test_crowded_shingles_lose_no_pair(spark, monkeypatch):
    """Passages that many texts share, with a limit so low that most are put behind."""
    import random

    from factorloom.llm import simhash

    random.seed(31)
    word = lambda: f"w{random.randrange(5000)}"
    passages = [[word() for _ in range(40)] for _ in range(4)]
    texts = []
    for n in range(160):
        body = [word() for _ in range(random.choice([0, 5, 12, 60]))] + passages[n % 4] + [word() for _ in range(random.choice([0, 3]))]
        texts.append(" ".join(body))
        if n % 5 == 0:
            texts.append(texts[-1])
    plain = simhash.members_of
    monkeypatch.setattr(simhash, "members_of", lambda t, k, least: plain(t, k, least, crowd=2))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect())
    sets, root = [set(simhash.shingle_hashes(t, 5)) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert kept == sorted({find(i) for i in range(len(texts))}) and len(kept) < len(texts) - 40


def test_no_join_of_growing_tables_broadcasts(spark, monkeypatch):
    """A table that grows with the input never goes through the driver, however small the planner takes it to be."""
    from factorloom.llm import simhash

    plans = []

    def seen(df, name, plain=simhash.stored):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(simhash, "stored", seen)
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    seen(simhash_components(df), "simhash-result")
    assert len(plans) > 8 and sum("SortMergeJoin" in p for p in plans) > 5
    assert not [p for p in plans if "Broadcast" in p]


def test_near_copies_come_by_fingerprint_variants(spark, monkeypatch):
    """Near copies are found by SimHash; without the exact check only pairs at the edge of the similarity are missed, and a crowd of copies gives no pairs with its square."""
    from factorloom.llm import simhash

    random.seed(12)
    rows, pairs = [], 0
    for changed in (1, 2, 3) * 30:
        w = [f"w{random.randrange(9000)}" for _ in range(220)]
        v = list(w)
        for at in random.sample(range(220), changed):
            v[at] = f"new{random.randrange(10**6)}"
        rows += [" ".join(w), " ".join(v)]
    w = [f"w{random.randrange(9000)}" for _ in range(400)]
    for n in range(300):
        rows.append(" ".join([*w, f"end{n}"]))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    made = {}

    def seen(prints, plain=simhash.near_prints):
        out = plain(prints)
        made["near"] = {(r.a, r.b) for r in out.collect()}
        return out

    monkeypatch.setattr(simhash, "near_prints", seen)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == [*range(0, 180, 2), 180]
    fp = {r.doc_id: r.fp for r in simhash.with_digests(df, "text", "fp", "print", 5).collect()}
    found = sum((min(fp[n], fp[n + 1]), max(fp[n], fp[n + 1])) in made["near"] for n in range(0, 180, 2))
    assert found >= 80
    assert 299 <= len(made["near"]) - found < 300 * 300 / 8
    for n in range(0, 180, 2):
        for m in (n + 2, n + 3):
            assert m >= 180 or (min(fp[n], fp[m]), max(fp[n], fp[m])) not in made["near"]


def test_texts_that_meet_by_chance_do_not_grow_with_the_square():
    """Variants have as many bits as the number of texts asks for."""
    from factorloom.llm.simhash import SEGMENTS, key_bits

    for texts in (2, 5000, 50_000, 250_000, 15_000_000, 1 << 32):
        bits = key_bits(texts)
        assert SEGMENTS * bits * texts / 2 ** (bits - 1) / 2 <= 2


def test_groups_of_near_copies_make_no_square_of_pairs(spark, monkeypatch):
    """Sixteen near copies are linked by some pairs each, not by all 120 pairs; variants are shuffled a part at a time."""
    from factorloom.llm import simhash

    random.seed(40)
    rows = []
    for group in range(20):
        base = [random.getrandbits(simhash.BITS) for _ in range(simhash.SEGMENTS)]
        for n in range(16):
            at, bit = divmod(random.randrange(simhash.SEGMENTS * 24), 24)
            rows.append((group * 100 + n, [p ^ (1 << bit if i == at else 0) for i, p in enumerate(base)]))
    met, members = [], []

    def seen(df, name, plain=simhash.stored):
        out = plain(df, name)
        (met if name == "similar-met" else members if name == "simhash-members" else []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", seen)
    near = simhash.near_prints(spark.createDataFrame(rows, "fp long, print array<long>"))
    roots = {r.node: r.root for r in components(near).collect()}
    assert roots == {fp: fp // 100 * 100 for fp, _ in rows}
    assert len(met) == 5 and max(met) < 20 * 40
    assert max(members) <= len(rows) * simhash.SEGMENTS * simhash.BITS / 5


def test_buckets_of_rows_let_few_others_through(spark):
    """Of many parts with many rows, hardly any but the rows that are asked for."""
    import numpy as np

    from factorloom.llm.simhash import buckets_of, within

    every = np.concatenate([np.arange(16000, dtype="<i8") + (part << 33) for part in range(16)])
    wanted = every[::13]
    passed = within(every, buckets_of(spark.createDataFrame([(int(u),) for u in wanted], "uid long"))).astype(bool)
    assert passed[::13].all() and passed.sum() < 1.01 * len(wanted)


def test_copies_give_their_first_shingles_once(spark):
    from factorloom.llm.simhash import with_digests, with_prefixes

    rows = [(n, f"one text in {n % 2} words that stand here many times over") for n in range(400)]
    texts = with_digests(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "text", "fp", "print", 5)
    found = with_prefixes(texts, 5, 0.8, {})
    assert found.count() == found.select("fp", "h").distinct().count() == 2 * 2
