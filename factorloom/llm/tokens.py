"""Token ids in Arrow IPC files, and the cached encoder that packing shares.

The file format is Arrow's random-access file (the stream messages, then a footer
of their offsets): batches of two fixed-size-list columns, ``input_ids`` (uint16
where the vocabulary allows it, else uint32) and ``mask`` (bits), one row per
sequence of equal length. ``SequenceFile`` maps a file and gives sequence n as a slice
of the value buffers, without a copy. Beside each lies a file of the documents' places.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import KEPT, scratch, stored, table, tidied

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
LONGEST = 64
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: And what only some regular expressions take for white space.
BLANK = SPACES | np.isin(np.arange(256), [28, 29, 30, 31])
#: First bytes of the characters beyond ASCII that are white space (and of many that are not).
LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordTable:
    """Ids of words by the words' 64-bit hashes: open addressing in arrays, so that many are looked up at once."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys, self.nth = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.pool, self.used, self.offsets, self.sizes, self.n = np.zeros(1 << 16, np.uint32), 0, np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), 0

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if it is new."""
        at = self.slots(hashes)
        out, open_ = self.nth[at], np.flatnonzero((self.keys[at] != hashes) & (self.nth[at] >= 0))
        while open_.size:
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            out[open_] = self.nth[at[open_]]
            open_ = open_[(self.keys[at[open_]] != hashes[open_]) & (out[open_] >= 0)]
        return out

    def add(self, ids: list[bytes]) -> np.ndarray:
        """Numbers for words of these ids; ``place`` makes them known."""
        sizes, flat = np.array([len(x) // 4 for x in ids], np.int64), np.frombuffer(b"".join(ids), "<u4")
        for name, need in (("pool", self.used + flat.size), ("offsets", self.n + sizes.size), ("sizes", self.n + sizes.size)):
            if need > len(getattr(self, name)):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros(need, getattr(self, name).dtype)]))
        self.pool[self.used : self.used + flat.size] = flat
        self.offsets[self.n : self.n + sizes.size] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + sizes.size] = sizes
        self.used, self.n = self.used + flat.size, self.n + sizes.size
        return np.arange(self.n - sizes.size, self.n, dtype=np.int32)

    def place(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        at = self.slots(hashes)
        while hashes.size:
            free = self.nth[at] < 0
            _, first = np.unique(at, return_index=True)
            wins = np.zeros(at.size, bool)
            wins[first] = True
            wins &= free
            self.keys[at[wins]], self.nth[at[wins]] = hashes[wins], numbers[wins]
            hashes, numbers, at = hashes[~wins], numbers[~wins], (at[~wins] + 1) & ((1 << self.bits) - 1)

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All the words' ids in turn, and the number of ids before each word and at the end."""
        sizes = self.sizes[numbers].astype(np.int64)
        ends = np.cumsum(sizes)
        shift = np.repeat(self.offsets[numbers] - (ends - sizes), sizes)
        return self.pool[shift + np.arange(shift.size)], np.concatenate([[0], ends])


class CachedEncoder:
    """Ids of whole texts, by a tokenizers file, through a table of its words' ids.

    Exact: texts are cut only where the tokenizer itself always ends a word, so
    the ids of the parts, joined, are the ids of the text. ``spaced`` tells that
    white space belongs to the following word (byte-level BPE): then a part ends
    before a space with a visible character on both sides. Otherwise the tokenizer
    drops white space, and parts are what ASCII white space divides. New words are
    encoded many in one text, with a digit that none of them has between them.
    The table holds ``most`` words and starts anew beyond that; longer parts than
    ``LONGEST`` bytes are encoded each time.
    """

    def __init__(self, path: str, spaced: bool, most: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True
        self.vocabulary = self.encoder.get_vocab_size()
        if hasattr(self.encoder.model, "_resize_cache"):  # its own cache costs more than it saves on words that are new
            self.encoder.model._resize_cache(0)
        self.spaced, self.most, self.known = spaced, most, WordTable()
        self.mark = self.ids(" 7" if spaced else "7")
        self.up = self.down = np.ones(0, np.uint64)

    def ids(self, text: str) -> bytes:
        return np.array(self.encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def parts(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes and ends of the parts of the texts that lie at begins to ends, with a line feed between."""
        if not self.spaced:
            edge = np.flatnonzero(np.diff(SPACES[data].astype(np.int8), prepend=1, append=1))
            return edge[0::2], edge[1::2]
        padded = np.concatenate([np.full(3, 10, np.uint8), data, np.full(1, 10, np.uint8)])
        clear = ~BLANK[padded]
        before = clear[2:-2] & ((padded[2:-2] < 0x80) | ~(LEADS[padded[1:-3]] | LEADS[padded[:-4]]))
        after = clear[4:] & ~LEADS[padded[4:]]
        cut = (data == 32) & before & after
        full = ends > begins
        cut[begins[full]] = True
        starts = np.flatnonzero(cut)
        stops = np.concatenate([starts[1:], [len(data)]])
        return starts, np.minimum(stops, ends[np.searchsorted(begins, starts, side="right") - 1])

    def hashes(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            self.up, self.down = powers(2 * len(data) + 1, BASE), powers(2 * len(data) + 1, pow(BASE, -1, 1 << 64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64)])
        h = (sums[stops] - sums[starts]) * self.down[starts] + (stops - starts).astype(np.uint64)
        for shift, factor in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
            h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
        return h

    def plain(self, part: str) -> bool:
        """It can stand in a joined text: it has no mark, and its ends are where words always end."""
        if not self.spaced:
            return "7" not in part
        return "7" not in part and len(part) > 1 and part[0] == " " and not part[1].isspace() and not part[-1].isspace()

    def learn(self, new: list[str]) -> list[bytes]:
        plain, made = [x for x in new if self.plain(x)], {}
        if len(self.mark) == 4:
            mark = int.from_bytes(self.mark, "little")
            for at in range(0, len(plain), 2000):
                some = plain[at : at + 2000]
                ids = self.ids((" 7" if self.spaced else " 7 ").join(some))
                ends = np.flatnonzero(np.frombuffer(ids, "<u4") == mark) * 4
                if len(ends) == len(some) - 1:
                    starts, ends = [0, *(ends + 4).tolist()], [*ends.tolist(), len(ids)]
                    made |= {x: ids[a:b] for x, a, b in zip(some, starts, ends, strict=True)}
        return [made[x] if x in made else self.ids(x) for x in new]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, each four bytes, little-endian."""
        raw = [(t or "").encode() for t in texts]
        whole = b"\n".join(raw)
        data = np.frombuffer(whole, np.uint8)
        sizes = np.array([len(x) for x in raw], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        begins = ends - sizes
        if not len(data):
            return [b""] * len(texts)
        if self.known.n > self.most:
            self.known.clear()
        starts, stops = self.parts(data, begins, ends)
        hashes = self.hashes(data, starts, stops)
        numbers = self.known.find(hashes)
        short = stops - starts <= LONGEST
        if (fresh := np.flatnonzero((numbers < 0) | ~short)).size:
            seen, first, back = np.unique(hashes[fresh], return_index=True, return_inverse=True)
            some = fresh[first]
            made = self.known.add(self.learn([whole[a:b].decode() for a, b in zip(starts[some].tolist(), stops[some].tolist(), strict=True)]))
            numbers[fresh] = made[back]
            keep = short[some]
            self.known.place(seen[keep], made[keep])
        ids, places = self.known.joined(numbers)
        at = places[np.searchsorted(starts, np.concatenate([begins, [len(data)]]))] * 4
        ids = ids.astype("<u4", copy=False).tobytes()
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode_each(self, column, chars: int = 1 << 18):
        """The ids of each text of an Arrow column, some texts at a time."""
        some, held = [], 0
        for text in column:
            some.append(text.as_py())
            held += len(some[-1] or "") + 64
            if held > chars:
                yield from self.encode(some)
                some, held = [], 0
        yield from self.encode(some)


_ENCODERS: dict[tuple, CachedEncoder] = {}
KEPT.append(_ENCODERS.clear)


def encoder(name: str, path: str | None, spaced: bool) -> CachedEncoder:
    """One encoder per Python worker. path: of the file; else that of the installed public tokenizer of this name."""
    key = (name, path, spaced)
    if key not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[key] = CachedEncoder(path or public_tokenizers.path(name), spaced)
    return _ENCODERS[key]


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put_in_place(store: fs.FileSystem, draft: str, path: str) -> None:
    """Give a finished draft its name, over what an earlier attempt of the task left there."""
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)
    store.move(draft, path)


PLACES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part long, ids_uri string, docs_uri string, docs long, tokens long, sequences long"


class SequenceWriter:
    """Joins ids to sequences of equal length and writes them, a bounded batch at a time."""

    def __init__(self, sink, length: int, wide: bool, rows: int = 256):
        self.length, self.room = length, length * rows
        self.kind = np.dtype("<u4" if wide else "<u2")
        kinds = [pa.list_(pa.uint32() if wide else pa.uint16(), length), pa.list_(pa.bool_(), length)]
        self.schema = pa.schema([("input_ids", kinds[0]), ("mask", kinds[1])])
        self.out, self.parts, self.held, self.written = pa.ipc.new_file(sink, self.schema), [], 0, 0

    def add(self, ids: bytes) -> None:
        view = memoryview(ids)
        while view:
            some = view[: 4 * (self.room - self.held)]
            self.parts.append(some)
            self.held += len(some) // 4
            view = view[len(some) :]
            if self.held == self.room:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        ids, self.parts = np.frombuffer(b"".join(self.parts), "<u4"), []
        rows = -(-self.held // self.length)
        full = np.zeros(rows * self.length, self.kind)
        full[: self.held] = ids
        mask = np.arange(full.size) < self.held
        both = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((full, mask), self.schema, strict=True)]
        self.out.write_batch(pa.RecordBatch.from_arrays(both, schema=self.schema))
        self.written, self.held = self.written + rows, 0

    def close(self) -> None:
        self.flush()
        self.out.close()


def write_token_files(df: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = "byte_bpe_50k.json", path: str | None = None, spaced: bool = True, end_id: int = 2, length: int = 2048) -> DataFrame:
    """Write df's texts in ascending id order; returns the manifest, a row per pair of files, with each one's first token.

    Ids are range-partitioned (ties by text; null ids come first), so file n holds
    smaller ids than file n + 1, each padded to whole sequences with the mask 0. A
    null or empty text is its end id alone; repeated rows are documents of their own;
    an empty table gives no document; other columns are not read. A task writes under a name of
    its own and moves the files into place, so a task that runs again does no harm.
    """
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    slim = slim.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    @tidied
    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        part, words = task.partitionId(), encoder(tokenizer, path, spaced)
        store, base = store_of(uri)
        store.create_dir(base, recursive=True)
        names = [f"{base}/{kind}-{part:08d}.arrow" for kind in ("ids", "docs")]
        drafts = [f"{x}.{task.taskAttemptId()}" for x in names]
        at, places, docs = 0, [], 0
        with store.open_output_stream(drafts[0]) as a, store.open_output_stream(drafts[1]) as b:
            out, index = SequenceWriter(a, length, max(words.vocabulary, end_id + 1) > 1 << 16), pa.ipc.new_file(b, PLACES)
            end = np.array([end_id], "<u4").tobytes()

            def close_places():
                index.write_batch(pa.RecordBatch.from_pylist(places, schema=PLACES))
                places.clear()

            for batch in batches:
                for doc, ids in zip(batch.column(0), words.encode_each(batch.column(1)), strict=True):
                    ids += end
                    out.add(ids)
                    places.append({"doc_id": doc.as_py(), "start": at, "n_tokens": len(ids) // 4})
                    at, docs = at + len(ids) // 4, docs + 1
                    if len(places) == 8192:
                        close_places()
            close_places()
            out.close()
            index.close()
        for draft, name in zip(drafts, names, strict=True):
            put_in_place(store, draft, name)
        row = [part, f"{uri}/ids-{part:08d}.arrow", f"{uri}/docs-{part:08d}.arrow", docs, at, out.written]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "ids_uri", "docs_uri", "docs", "tokens", "sequences"])

    made = stored(slim.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))


class SequenceFile:
    """Random access to the sequences of one file; a file of this machine is mapped, and what is returned lies in the map.

    All batches but the last have as many rows, so sequence n is row n % rows of batch n // rows.
    """

    def __init__(self, uri: str):
        store, at = store_of(uri)
        self.source = pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at)
        self.file = pa.ipc.open_file(self.source)
        self.batches, self.held = self.file.num_record_batches, (-1, None)
        self.length = self.file.schema.field("input_ids").type.list_size
        self.rows = self.batch(0).num_rows if self.batches else 0

    def __enter__(self) -> SequenceFile:
        return self

    def __exit__(self, *_) -> None:
        self.held = (-1, None)
        self.source.close()

    def __len__(self) -> int:
        return (self.batches - 1) * self.rows + self.batch(self.batches - 1).num_rows if self.batches else 0

    def batch(self, k: int) -> pa.RecordBatch:
        if self.held[0] != k:
            self.held = (k, self.file.get_batch(k))
        return self.held[1]

    def values(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """All ids of a batch in turn, and their mask."""
        ids, mask = (c.flatten() for c in self.batch(k).columns)
        return ids.to_numpy(zero_copy_only=True), mask

    def sequence(self, n: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence n, both views of the file's own bytes."""
        if not 0 <= n < len(self):
            raise IndexError(f"sequence {n} of {len(self)}")
        ids, mask = self.values(n // self.rows)
        at = n % self.rows * self.length
        return ids[at : at + self.length], mask.slice(at, self.length)


def read_ids(ids_uri: str, docs_uri: str):
    """(doc_id, start in this file, ids as bytes) of each document, batch after batch of both files."""
    store, at = store_of(docs_uri)
    with SequenceFile(ids_uri) as ids, store.open_input_file(at) as b:
        docs = pa.ipc.open_file(b)
        held, begins, nth = np.zeros(0, "<u2"), 0, 0
        for k in range(docs.num_record_batches):
            batch = docs.get_batch(k)
            for doc, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts, need = [], n
                while need:
                    if start + n - need >= begins + held.size:
                        begins += held.size
                        held, mask = ids.values(nth)
                        held, nth = held[: mask.true_count], nth + 1
                    lo = start + n - need - begins
                    parts.append(held[lo : lo + need])
                    need -= parts[-1].size
                yield doc, start, np.concatenate(parts).astype("<u4").tobytes()


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    @tidied
    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for doc, start, ids in read_ids(row["ids_uri"], row["docs_uri"]):
                    out.append((doc, row["first_token"] + start, len(ids) // 4, zlib.crc32(ids)))
                    if len(out) == 8192:
                        yield batch_of(out)
                        out = []
                yield batch_of(out)

    def batch_of(rows):
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=names)

    return manifest.repartition(max(1, min(manifest.count(), 20_000))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark, sf_dir):
    manifest = stored(write_token_files(table(spark, sf_dir, "documents"), scratch(spark, "tokens")), "token-places")
    return read_documents(manifest)
