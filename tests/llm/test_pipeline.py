"""The pipeline against plain versions of its stages."""

import json
from collections import Counter

import corpus_pipeline as p

from factorloom.llm.common import table
from factorloom.llm.simhash import shingle_hashes

from .test_contamination import plain as plain_contaminated
from .test_secrets import base


def alone(texts):
    """The smallest id of each component of pairs whose sets of five-word shingles have a similarity of 0.8 or more, all pairs compared."""
    sets = {d: frozenset(shingle_hashes(t, 5)) for d, t in sorted(texts.items())}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, x in sets.items():
        for e, y in sets.items():
            if e < d and len(x & y) >= 0.8 * len(x | y):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {find(d) for d in sets}


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    columns = docs.columns
    frames, before = {}, docs
    for name, stage in p.STAGES:
        frames[name] = stage(spark, before, small).cache()
        if name != "packing":
            assert frames[name].columns == columns and dict(frames[name].dtypes) == dict(docs.dtypes)
        before = frames[name]
    rows = {n: {r.doc_id: r for r in f.collect()} for n, f in frames.items() if n != "packing"}
    every = {r.doc_id: r for r in docs.collect()}
    assert len(rows["language"]) > 0.95 * len(every)
    assert rows["near_duplicates"].keys() == alone({d: r.text for d, r in rows["language"].items()})
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    bad = {d for d, _ in plain_contaminated([(d, r.text) for d, r in rows["near_duplicates"].items()], items)}
    assert bad and rows["contamination"].keys() == rows["near_duplicates"].keys() - bad
    assert rows["secrets"].keys() == rows["contamination"].keys()
    masked = 0
    for d, r in rows["secrets"].items():
        old = rows["contamination"][d].text
        assert (r.text == old) or "[secret]" in r.text and base(old)
        assert not base(r.text) and r.n_chars == len(r.text)
        masked += r.text != old
    assert masked == sum(bool(base(r.text)) for r in rows["contamination"].values()) > 0
    packed = frames["packing"].collect()
    assert {r.doc_id for r in packed} == rows["secrets"].keys()
    held = Counter()
    for r in packed:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 4096
    again = p.run(spark, small)
    strip = lambda rs: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert strip(again.collect()) == strip(packed)


def test_empty_and_odd_documents(spark, small, tmp_path):
    schema = table(spark, small, "documents").schema
    none = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, None, "en", "s", None), (None, "Some words of plain text here.", None, None, 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], schema)
    for df in (none, odd):
        for name, stage in p.STAGES:
            df = stage(spark, df, small)
            assert name == "packing" or df.columns == schema.names
        json.dumps(df.count())
