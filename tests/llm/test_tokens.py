"""op7 and the encoder: exact ids, and a round trip through the files."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from factorloom.llm.common import scratch
from factorloom.llm.tokens import CachedEncoder, SequenceFile, SequenceWriter, encoder, read_documents, store_of, write_token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["", "  ", " a", "a ", "a  b", "\n\n a\t b", "it's we'll  'S", "7 7 777 a7", "<|endoftext|> x <|startoftext|>", "é é ́x", "İSTANBUL ΣΑΣ", "a\0b c", "x\x1cy \x85 z　w\xa0q", "日本語 テキスト 7", "😀 😀a  😀", "A" * 300 + " b", " \n", "\n", " 7", "a\r\nb  \r\n c", "\x1c", "\x85"]


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("most", [10**6, 50])
def test_ids_are_the_tokenizers(name, spaced, most):
    random.seed(1)
    alpha = list("aB7 \n\t'sé́.,!?  9\x1c\x85\xa0　Σİ日😀\0")
    texts = [*ODD, None, *["".join(random.choices(alpha, k=random.randint(1, 60))) for _ in range(1500)]]
    made, want = CachedEncoder(public_tokenizers.path(name), spaced, most), plain(name)
    for at in range(0, len(texts), 97):
        assert made.encode(texts[at : at + 97]) == [want(t) for t in texts[at : at + 97]]


@pytest.mark.parametrize(("length", "wide"), [(8, False), (5, True)])
def test_sequences_are_zero_copy(tmp_path, length, wide):
    with pa.OSFile(str(tmp_path / "x"), "wb") as f:
        w = SequenceWriter(f, length, wide=wide, rows=3)
        w.add(np.arange(50, dtype="<u4").tobytes())
        w.close()
    with SequenceFile(f"file://{tmp_path}/x") as made:
        assert made.file.schema.field("input_ids").type == pa.list_(pa.uint32() if wide else pa.uint16(), length)
        allocated, order = pa.total_allocated_bytes(), list(range(w.written))
        random.shuffle(order)
        made.source.seek(0)
        whole = made.source.read_buffer()
        begin, size = whole.address, whole.size
        for n in order:
            ids, mask = made.sequence(n)
            assert begin <= ids.__array_interface__["data"][0] and ids.__array_interface__["data"][0] + ids.nbytes <= begin + size
            bits = mask.buffers()[1]
            assert begin <= bits.address <= begin + size and not bits.is_mutable and not ids.flags.writeable
            held = mask.to_pylist()
            assert ids[held].tolist() == list(range(n * length, min(50, (n + 1) * length))) and ids[~np.array(held)].sum() == 0
        assert pa.total_allocated_bytes() == allocated and len(made) == w.written == -(-50 // length)
        for n in (-1, len(made)):
            with pytest.raises(IndexError):
                made.sequence(n)


def test_round_trip(spark):
    random.seed(2)
    rows = [(n * 7 % 101, " ".join(random.choices(ODD, k=random.randint(0, 40))), "z", 0) for n in range(100)]
    rows += [(200, None, None, None), (None, "no id", None, None), (5000, "word " * 9000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(6)
    want, at = [], 0
    ids_of = plain("byte_bpe_50k.json")
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = ids_of(text) + (2).to_bytes(4, "little")
        want.append((doc, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    manifest = write_token_files(df, scratch(spark, "t"), length=64).cache()
    assert sorted(map(tuple, read_documents(manifest).collect()), key=lambda r: r[1]) == want
    assert manifest.agg({"tokens": "sum"}).first()[0] == at


def test_repeated_rows_and_empty_table(spark):
    one = spark.createDataFrame([(1, "a b")] * 4, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, read_documents(write_token_files(one, scratch(spark, "t"))).collect()))
    assert len(got) == 4 and len({r[3] for r in got}) == 1 and [r[1] for r in got] == [0, 3, 6, 9]
    none = one.limit(0)
    assert read_documents(write_token_files(none, scratch(spark, "t"))).count() == 0


def test_encoder_is_kept_and_paths_resolve(tmp_path):
    assert encoder("byte_bpe_50k.json", None, True) is encoder("byte_bpe_50k.json", None, True)
    assert store_of(str(tmp_path))[1] == str(tmp_path) == store_of(f"file://{tmp_path}")[1]
