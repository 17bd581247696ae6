"""Token ids in fixed-width bit-packed files.

``write_token_ids`` range-sorts documents by id, encodes their whole texts and
writes one file for each range; every id takes the fewest bits that hold the
vocabulary.  A file is a run of independently packed blocks of ``BLOCK_IDS`` ids,
a table of block offsets, and a table with each document's id and first token, so
any document is read by unpacking only the blocks that hold it.

File layout (little endian): magic, blocks, then int64 block offsets, int64
document ids, one byte each for "id is not null", int64 first token of each
document, and a fixed footer (:data:`FOOTER`).

A task writes under a name of its own and reports it; only names that the
committed manifest lists count, so retried and duplicated tasks do no harm.

Defined results: a null text is an empty one, which has only the end id; null
document ids sort first; repeated rows are written each; an empty table has an
empty manifest.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage, textscan

MAGIC = b"KBIDS\x00\x00\x01"
#: width, ids in a block, blocks, documents, ids, offset of the block table, magic
FOOTER = struct.Struct("<IIQQQQ8s")
BLOCK_IDS = 1 << 16
#: Bytes of text for each file.
SHARD_BYTES = 32 << 20
END_ID = 0


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold ids below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as a little-endian bit stream."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a bit stream."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Streams documents' ids into one file."""

    def __init__(self, uri: str, width: int, block_ids: int = BLOCK_IDS):
        files, path = storage.filesystem(uri)
        files.create_dir(os.path.dirname(path), recursive=True)
        self.out = files.open_output_stream(path)
        self.width, self.block = width, block_ids
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.crc = 0
        self.at = len(MAGIC)
        self.blocks: list[int] = []
        self.keys: list[np.ndarray] = []
        self.valid: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.out.write(data)

    def _flush(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.blocks.append(self.at)
        self._put(data)
        self.at += len(data)

    def add(self, keys: np.ndarray, valid: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Append documents: their keys, and their ids one after another."""
        self.keys.append(keys)
        self.valid.append(valid)
        self.firsts.append(self.n_ids + np.cumsum(counts) - counts)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            ids = np.concatenate(self.held)
            for i in range(0, len(ids) - self.block + 1, self.block):
                self._flush(ids[i : i + self.block])
            ids = ids[len(ids) // self.block * self.block :]
            self.held, self.n_held = [ids], len(ids)

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes) written."""
        if self.n_held:
            self._flush(np.concatenate(self.held))
        keys = np.concatenate(self.keys or [np.zeros(0, np.int64)]).astype("<i8")
        table = self.at
        for part in (np.array(self.blocks, "<i8"), keys, np.concatenate(self.valid or [np.zeros(0, bool)]).astype(np.uint8), np.concatenate(self.firsts or [np.zeros(0, np.int64)]).astype("<i8")):
            self._put(part.tobytes())
            self.at += part.nbytes
        self._put(FOOTER.pack(self.width, self.block, len(self.blocks), len(keys), self.n_ids, table, MAGIC))
        self.out.close()
        return len(keys), self.n_ids, self.at + FOOTER.size


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        files, path = storage.filesystem(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        self.width, self.block, n_blocks, n_docs, self.n_ids, table, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.file.seek(table)
        take = lambda kind, n: np.frombuffer(self.file.read(np.dtype(kind).itemsize * n), kind)
        self.blocks = np.append(take("<i8", n_blocks), table)
        self.keys, self.valid = take("<i8", n_docs), take(np.uint8, n_docs).astype(bool)
        self.firsts = np.append(take("<i8", n_docs), self.n_ids)

    def read_block(self, i: int) -> np.ndarray:
        self.file.seek(int(self.blocks[i]))
        return unpack(self.file.read(int(self.blocks[i + 1] - self.blocks[i])), self.width, min(self.block, self.n_ids - i * self.block))

    def ids(self, first: int, end: int) -> np.ndarray:
        """Tokens [first, end) of the file."""
        if end <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (end - 1) // self.block
        joined = np.concatenate([self.read_block(i) for i in range(a, b + 1)])
        return joined[first - a * self.block : end - a * self.block]

    def document(self, i: int) -> np.ndarray:
        """All ids of the file's i-th document."""
        return self.ids(int(self.firsts[i]), int(self.firsts[i + 1]))

    def documents(self, batch: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(i, j, ids of documents i to j - 1), about ``batch`` ids at a time."""
        i, n = 0, len(self.keys)
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(self.firsts, self.firsts[i] + batch, "right")) - 1))
            yield i, j, self.ids(int(self.firsts[i]), int(self.firsts[j]))
            i = j

    def close(self) -> None:
        self.file.close()


_WHITE = textscan.byte_class((0x09, 0x0D), (0x20, 0x20))
#: Bytes that may be, or may begin, white space other than the common kinds.
_UNSURE = textscan.byte_class((0x1C, 0x1F), (0xC2, 0xC2), (0xE1, 0xE3))
_SLOTS = 1 << 20
_POOL = 4 << 20
#: Bytes of text that a slice holds, and that one call gives to the tokenizers library.
_SLICE, _CALL = 1 << 18, 1 << 17
#: Longer pieces are known by all their bytes, the others by two 8-byte words and their length.
_SHORT = 16
_LONG_HELD = 1 << 16
#: Cut points that a vocabulary's pre-tokeniser must share for its texts to be cut.
_PROBES = ["a b", "a  b c", "x1 y2, z.", "it's a (test) of\nlines\nand  more \n", "\n\na \t b\r\n c", "don't 12345 67! ?? -- é à\u00a0b \u3000c\nd", " lead trail ", "Straße\nÜber 日本 語\nx", "a" * 40 + " " + "b" * 40 + "\n" + "c" * 40]


class Encoder:
    """Encodes texts with a byte-level BPE of the ``tokenizers`` library.

    The pre-tokeniser of such a vocabulary always breaks before a space that a
    visible character follows, and around a line feed between visible characters.
    Texts are cut there, and each different piece is given to the library once
    for as long as it stays in a table of fixed size.  A piece counts as known only
    if all its bytes are the same.  With a vocabulary that does not break there
    whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size()
        feed = self._encode(["\n", "a\nb", "a\n b"])
        self.feed = int(feed[0][0]) if len(feed[0]) == 1 and all(list(x).count(feed[0][0]) == 1 and len(x) == 3 for x in feed[1:]) else None
        self.release()
        self.cut = all(self._encode([t])[0] == [i for x in self._encode(self._pieces(t)) for i in x] for t in _PROBES)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, text: str) -> list[str]:
        raw = text.encode()
        at = [*self.cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).tolist(), len(raw)]
        return [raw[a:b].decode() for a, b in zip(at, at[1:], strict=False)]

    def release(self) -> None:
        """Give the tables' memory back."""
        self.slots = None
        self.long: dict[bytes, tuple[int, int]] = {}
        self.pool, self.used = np.zeros(0, np.uint32), 0

    def _clear(self) -> None:
        self.release()
        #: Of each slot: a piece's first and last bytes, its length, and the place and number of its ids.
        self.slots = [np.zeros(_SLOTS, kind) for kind in (np.uint64, np.uint64, np.int32, np.int32, np.int32)]
        self.pool = np.zeros(1 << 18, np.uint16 if self.vocabulary <= 1 << 16 else np.uint32)

    @staticmethod
    def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where pieces start, for the bytes of documents at offsets ``at``."""
        white = _WHITE[data]
        visible = ~(white | _UNSURE[data])
        begins = np.zeros(len(data) + 1, bool)
        begins[at] = True
        after = np.zeros(len(data), bool)
        after[:-1] = visible[1:] & ~begins[1:-1]
        cut = (data == 0x20) & after
        # A visible ASCII character ends before a line feed.
        feeds = np.flatnonzero(data == 0x0A)
        feeds = feeds[feeds > 0]
        feeds = feeds[visible[feeds - 1] & (data[feeds - 1] < 0x80)]
        cut[feeds] = True
        feeds = feeds[after[feeds]]
        cut[feeds + 1] = True
        cut |= begins[:-1]
        return np.flatnonzero(cut)

    def _keep(self, ids: np.ndarray) -> int:
        """Put ids into the pool; where they are."""
        at, end = self.used, self.used + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(max(end, 2 * len(self.pool)) - at, self.pool.dtype)])
        self.pool[at:end] = ids
        self.used = end
        return at

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces, a bounded part of them at a time; where their ids are in the pool, and how many."""
        begun, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at = np.concatenate([[0], np.cumsum(ends - starts)])
        for a, b in textscan.slices(at, _CALL):
            begun[a:b], n[a:b] = self._learn_part(data, starts[a:b], ends[a:b])
        return begun, n

    def _learn_part(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begun, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        size = ends - starts
        whole = np.cumsum(size) - size
        flat = data[np.arange(int(size.sum())) + np.repeat(starts - whole, size)]
        odd = np.add.reduceat((_WHITE[flat] | _UNSURE[flat]).astype(np.int64), whole) - (data[starts] == 0x20)
        plain = (odd == 0) & (size > (data[starts] == 0x20)) & (self.feed is not None)
        if plain.any():
            # Pieces of one line each, so that one call encodes them and line feeds tell them apart.
            s, k = starts[plain], size[plain]
            to = np.cumsum(k + 1) - k - 1
            joined = np.full(int((k + 1).sum()), 0x0A, np.uint8)
            inner = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            joined[np.repeat(to, k) + inner] = data[np.repeat(s, k) + inner]
            ids = np.array(self._encode([joined.tobytes().decode()])[0], np.uint32)
            stops = np.flatnonzero(ids == self.feed)
            if len(stops) == len(s):
                firsts = np.concatenate([[0], stops[:-1] + 1])
                begun[plain], n[plain] = self._keep(ids) + firsts, stops - firsts
            else:
                plain[:] = False
        rest = np.flatnonzero(~plain)
        if len(rest):
            for i, ids in zip(rest.tolist(), self._encode([data[starts[i] : ends[i]].tobytes().decode() for i in rest]), strict=True):
                begun[i], n[i] = self._keep(np.array(ids, np.uint32)), len(ids)
        return begun, n

    def _short(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of pieces of at most ``_SHORT`` bytes."""
        size = ends - starts
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
        head = eight[starts] & _HEADS[np.minimum(size, 8)]
        tail = np.where(size > 8, eight[np.maximum(ends - 8, 0)], np.uint64(0))
        with np.errstate(over="ignore"):
            mark = textscan.mix(head * np.uint64(0x9FB21C651E98DF25) + tail * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64))
        slot = (mark & np.uint64(_SLOTS - 1)).astype(np.int64)
        heads, tails, sizes, places, numbers = self.slots
        known = (heads[slot] == head) & (tails[slot] == tail) & (sizes[slot] == size)
        begun, n = places[slot].astype(np.int64), numbers[slot].astype(np.int64)
        missing = np.flatnonzero(~known)
        if len(missing):
            _, first, back = np.unique(mark[missing], return_index=True, return_inverse=True)
            own = missing[first]
            # Pieces that share a mark by chance and are not the same.
            other = (head[missing] != head[own][back]) | (tail[missing] != tail[own][back]) | (size[missing] != size[own][back])
            order = np.argsort(own)
            b, c = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
            b[order], c[order] = self._learn(data, starts[own[order]], ends[own[order]])
            begun[missing], n[missing] = b[back], c[back]
            if other.any():
                strange = missing[other]
                begun[strange], n[strange] = self._learn(data, starts[strange], ends[strange])
            # Of new pieces of one slot the last stays, whole.
            last = len(own) - 1 - np.unique(slot[own][::-1], return_index=True)[1]
            at = slot[own[last]]
            heads[at], tails[at], sizes[at], places[at], numbers[at] = head[own[last]], tail[own[last]], size[own[last]], b[last], c[last]
        return begun, n

    def _long(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of longer pieces."""
        names = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        new: dict[bytes, int] = {}
        for i, name in enumerate(names):
            if name not in self.long and name not in new:
                new[name] = i
        if new:
            at = np.fromiter(new.values(), np.int64, len(new))
            self.long.update(zip(new, zip(*(x.tolist() for x in self._learn(data, starts[at], ends[at])), strict=True), strict=True))
        found = np.array([self.long[name] for name in names], np.int64).reshape(-1, 2)
        if sum(map(len, new)) > _CALL or len(self.long) > _LONG_HELD:
            self.long = {}
        return found[:, 0], found[:, 1]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after another, number of ids of each)."""
        at = at - at[0]
        n_docs = len(at) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_docs, np.int64)
        if not self.cut:
            found = self._encode([data[a:b].tobytes().decode() for a, b in zip(at, at[1:], strict=False)])
            return np.concatenate([np.array(x, np.uint32) for x in found]), np.array([len(x) for x in found], np.int64)
        if self.slots is None or self.used > _POOL:
            self._clear()
        starts = self.cuts(data, at)
        ends = np.append(starts[1:], len(data))
        begun, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        short = ends - starts <= _SHORT
        for part, find in ((np.flatnonzero(short), self._short), (np.flatnonzero(~short), self._long)):
            if len(part):
                begun[part], n[part] = find(data, starts[part], ends[part])
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(begun - total[:-1], n) + np.arange(total[-1])].astype(np.uint32)
        bounds = total[np.searchsorted(starts, at)]
        bounds[-1] = total[-1]
        return ids, np.diff(bounds)


#: Masks of the first bytes of a piece of 0 to 8 bytes.
_HEADS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)

_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file; its tables are given back when a task ends."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def append_end(ids: np.ndarray, counts: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids with the end id after them."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    mask = np.ones(len(out), bool)
    mask[np.cumsum(counts + 1) - 1] = False
    out[mask] = ids
    return out, counts + 1


MANIFEST = "shard int, path string, n_docs long, n_ids long, n_bytes long, crc32 long"


def write_token_ids(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode and write all documents in ascending order of their integer id; returns the committed manifest."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    root = storage.new_dir(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out = TaskContext.get().partitionId(), None
        for batch in batches:
            code = encoder(tokenizer)
            keys = batch.column("doc_id")
            valid = keys.is_valid().to_numpy(zero_copy_only=False)
            keys = keys.fill_null(0).to_numpy()
            raw, at = textscan.string_buffers(batch.column("text"))
            for a, b in textscan.slices(at, _SLICE):
                if out is None:
                    path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
                    out = Writer(path, width_of(max(code.vocabulary, end_id + 1)))
                out.add(keys[a:b], valid[a:b], *append_end(*code.encode(raw[at[a] : at[b]], at[a : b + 1]), end_id))
        if out is not None:
            code.release()
            n_docs, n_ids, n_bytes = out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [n_docs], "n_ids": [n_ids], "n_bytes": [n_bytes], "crc32": [out.crc]})

    ranged = rows.repartitionByRange(int(size // shard_bytes) + 1, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return storage.materialise(ranged.mapInArrow(run, MANIFEST), spark, "manifest")


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def token_digests(manifest: DataFrame) -> DataFrame:
    """Read all files of a manifest back: each document's first position among all ids, its length and the CRC-32 of its ids."""
    # One row for each file: a sum over all of them is small.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                file = Reader(path)
                for i, j, ids in file.documents():
                    first = file.firsts[i : j + 1]
                    data = memoryview(ids.astype("<u4").tobytes())
                    at = ((first - first[0]) * 4).tolist()
                    sums = [zlib.crc32(data[at[k] : at[k + 1]]) for k in range(j - i)]
                    yield pa.RecordBatch.from_arrays([pa.array(file.keys[i:j], mask=~file.valid[i:j]), pa.array(base + first[:-1]), pa.array(np.diff(first)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                file.close()

    return files.repartition(max(1, n)).mapInArrow(run, DIGEST)


def read_token_ids(manifest: DataFrame) -> DataFrame:
    """Read all files of a manifest back as (doc_id, ids)."""
    n = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                file = Reader(path)
                for i, j, ids in file.documents():
                    first = file.firsts[i : j + 1]
                    lists = pa.ListArray.from_arrays(pa.array((first - first[0]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(file.keys[i:j], mask=~file.valid[i:j]), lists], names=["doc_id", "ids"])
                file.close()

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return manifest.select("path").repartition(max(1, n)).mapInArrow(run, schema)
