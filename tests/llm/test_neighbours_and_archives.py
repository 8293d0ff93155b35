"""op9 against exact search; op10 against SQL and round trips."""

import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import archives
from factorloom.llm.common import scratch, table
from factorloom.llm.neighbours import Block, fitted_share, nearest, nearest_pivots, op9_permutation_ann

from ..conftest import same


def exact(rows, k=10):
    out = {}
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    for n, (q, v) in enumerate(ok):
        if q % 100 == 0:
            scored = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for m, (i, w) in enumerate(ok) if m != n)
            out.setdefault(q, []).append([(i, s) for s, i in scored[:k]])
    return out


def test_all_are_reranked_when_the_share_is_one(spark):
    random.seed(1)
    rows = [(n, [random.choice([0.0, 1.0, 2.0]) for _ in range(6)]) for n in range(700)]
    rows += [(800, None), (900, [0.0] * 6), (1000, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [float("nan")] + [1.0] * 5), (1200, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (1300, [1.0] * 5), (200, rows[200][1]), (3000, [1e30] * 6)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, uid int, v string").repartition(5)
    got = {}
    for r in nearest(df, F.col("vec_id") % 100 == 0, pivots=20, prefix=8, share=1.0, block=150, chunk=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact([r for r in rows if r[0] != 1300])
    assert got.keys() == want.keys()
    for q, lists in want.items():
        if len(lists) == 1:
            assert [i for _, i, _ in got[q]] == [i for i, _ in lists[0]] and [s for _, _, s in got[q]] == pytest.approx([s for _, s in lists[0]]) and [r for r, _, _ in got[q]] == list(range(1, 11))
    assert len(got[200]) == 20 and got[200][0][2] == 0


def test_recall(spark, small):
    rows = [(r.vec_id, r.embedding) for r in table(spark, small, "embeddings").collect()]
    want, got = exact(rows), {}
    for r in op9_permutation_ann(spark, small).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = [got[q].get(i) == pytest.approx(s) for q, lists in want.items() for i, s in lists[0] if True]
    assert np.mean(hits) >= 0.9


def test_recall_over_several_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, F.col("vec_id") % 100 == 0, block=1500, chunk=40).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 6000, 100):
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hit / 600 >= 0.9


def test_footrule_from_postings():
    rng = np.random.default_rng(2)
    rows, pivots = rng.normal(size=(50, 4)), rng.normal(size=(12, 4))
    index = Block.of(np.arange(50), np.arange(50), rows, pivots, 5)
    orders = nearest_pivots(index.vectors, pivots, 5)
    place = lambda o, p: int(np.flatnonzero(o == p)[0]) if p in o else 5
    for q in orders[:10]:
        gain = index.closeness(q)
        rule = np.array([sum(abs(place(q, p) - place(o, p)) for p in range(12)) for o in orders])
        assert len(set((gain + rule).tolist())) == 1


def test_layout_does_not_matter(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    hot = df.where("vec_id % 3 = 0").withColumn("embedding", F.lit([0.5] * 64).cast("array<float>"))
    df = hot.unionByName(df.where("vec_id % 3 > 0")) if len(df.first().embedding) == 64 else df
    runs = [sorted(map(tuple, nearest(df.repartition(n), F.col("vec_id") % 100 == 0, block=300, chunk=7).collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 10 * df.where("vec_id % 100 = 0").count()


def test_clustered_vectors_need_a_small_share(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 32)) * 4
    v = centres[rng.integers(0, 150, 6000)] + rng.normal(size=(6000, 32))
    pivots = v[:256]
    assert fitted_share(v[:2048], pivots, 20, 10, 0.95) < 0.1
    df = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, F.col("vec_id") % 100 == 0, block=2000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 6000, 100):
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hit / 600 >= 0.9


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1.0)]
    for some in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 0")):
        assert nearest(some, F.col("vec_id") % 100 == 0).count() == 0


def pages():
    random.seed(3)
    long = ["x" * 1000, "é" * 500, "<p>" + "word " * 400]
    rows = [(n, random.choice(["http://a.b/c d", None, "", "http://é.example/?q=1#f"]), random.choice([*long, "x" * 999, "short", None, "", "a\r\n\r\nb" * 300, f"own {n} " * 200])) for n in range(200)]
    return [*rows, (9999, "u", "z" * 50_000), (9998, "u", "z" * 50_000)]


def test_archives_against_sql_rules(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "page_id long, url string, html string, bytes int, FILE string").repartition(5)
    last, want = {}, []
    for n, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), n)
    for n, _, h in rows:
        body = (h or "").encode()
        again = len(body) >= 1000 and last[h or ""] != n
        want.append((n, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last[h or ""] if again else None))
    got = archives.archive(df)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_repeated_rows_null_ids_and_empty_table(spark):
    big = "y" * 2000
    df = spark.createDataFrame([(1, "u", big), (1, "u", big), (None, "u", big), (None, None, None)], "page_id long, url string, html string").repartition(2)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in archives.archive(df).collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "revisit", 1), (None, "revisit", 1), (None, "response", None)], key=str)
    assert archives.archive(df.limit(0)).count() == 0


def test_query_is_its_sql(spark, small):
    same(archives.op10_warc(spark, small), small, archives.OP10_SQL)


@pytest.mark.parametrize("version", [1, 2])
def test_headers_of_both_versions(version):
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + bytes(range(256))
    data = archives.arc_record(version, "http://a b/\n", "20240102030405", block, "f.arc", 77)
    fields, got = archives.parse_record(b"\n" + data, version)
    assert got == block and fields["url"] == "http://a%20b/%0A" and fields["date"] == "20240102030405" and int(fields["length"]) == len(block)
    assert archives.parse_version(archives.version_block(version, "f.arc", "20240102030405")) == version
    old = f"http://x/with space 1.2.3.4 20240102030405 text/html{' 200 - - 0 f' if version == 2 else ''} 3\nabcdef".encode()
    assert archives.parse_record(old, version)[0]["url"] == "http://x/with space" and archives.parse_record(old, version)[1] == b"abc"
    with pytest.raises(ValueError):
        archives.parse_record(old[:-5], version)


def test_members_and_bad_files():
    parts = [b"", b"one", b"x" * 3_000_000]
    data = b"".join(map(archives.gzipped, parts))
    found = list(archives.members(io.BytesIO(data)))
    assert [c for _, _, c in found] == parts and all(gzip.decompress(data[a : a + n]) == c for a, n, c in found)
    with pytest.raises(ValueError):
        list(archives.members(io.BytesIO(data[:-9])))
    with pytest.raises(ValueError):
        archives.parse_version(b"nothing\n1 0 x\n")


def test_warc_files_are_well_formed(spark):
    df = spark.createDataFrame(pages()[:20], "page_id long, url string, html string")
    arcs = archives.write_arcs(df, scratch(spark, "arc")).cache()
    index = archives.index_arcs(arcs, 2).cache()
    files = archives.convert_arcs(index, scratch(spark, "warc"), 2).collect()
    kinds = []
    for f in files:
        with open(f.file.removeprefix("file://"), "rb") as stream:
            for _, _, content in archives.members(stream):
                fields, block = archives.parse_warc(content)
                kinds.append(fields["warc-type"])
                if kinds[-1] != "warcinfo":
                    assert fields["warc-date"] == "2024-01-01T00:00:00Z" and fields["warc-record-id"].startswith("<urn:uuid:") and block.startswith(b"HTTP/1.1")
    assert kinds.count("response") + kinds.count("revisit") == 20 == sum(f.records for f in files)
