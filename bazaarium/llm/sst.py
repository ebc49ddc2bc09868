"""Token-id shards as sorted string tables, and their readers.

A shard holds documents in ascending key order.  Layout, all integers little-endian:

* data blocks: entries of ``shared:u16 unshared:u16 size:u32 key-suffix value``; the first entry of each block
  shares nothing, so a block can be read alone; a CRC-32 of the block follows it;
* block index: per block ``key-length:u16 key offset:u64 size:u32`` with the block's first key (sparse: one per block);
* Bloom filter over document ids: ``bits:u64 probes:u32`` and the bit array;
* footer of fixed size: offsets and sizes of index and filter, entries, tokens, bytes per id, a magic word.

A key is the document id (8 bytes, big-endian, sign bit flipped so that bytes sort as numbers) and the row's place (8
bytes), so that ids which repeat keep an entry each.  A value is the ids of the document, its end id included.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarium.llm.byte_bpe import opened
from bazaarium.llm.tables import id_and_text, new_path, slices, written

BLOCK_BYTES = 32 << 10
SHARD_TEXT_BYTES = 64 << 20
BLOOM_BITS, BLOOM_PROBES = 10, 7
_ENTRY, _INDEX, _FOOTER = struct.Struct("<HHI"), struct.Struct("<QI"), struct.Struct("<QQQQQQI8s")
_MAGIC = b"TOKSST01"


def key_of(doc_id: int | None, place: int = 0) -> bytes:
    """Bytes that sort as (doc_id, place) does; a null id has a key of its own before all others."""
    if doc_id is None:
        return b"\x00" * 9 + place.to_bytes(8, "big")
    return b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big") + place.to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:9], "big") - (1 << 63) if key[0] else None


def _probes(stem: bytes, bits: int, probes: int) -> list[int]:
    """Bloom positions of a document id by double hashing."""
    a, b = zlib.crc32(stem), zlib.crc32(stem, 0x9E3779B9) | 1
    x = (a << 32 | b) * 0xFF51AFD7ED558CCD & (1 << 64) - 1
    return [((x >> 20) + i * (b << 1 | 1)) % bits for i in range(probes)]


class Writer:
    """Write entries given in ascending key order to a file object."""

    def __init__(self, sink, id_bytes: int):
        self.sink, self.id_bytes = sink, id_bytes
        self.at, self.block, self.last, self.first = 0, bytearray(), b"", b""
        self.index, self.stems = bytearray(), []
        self.entries = self.tokens = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.last = key
        self.stems.append(key[:9])
        self.entries += 1
        self.tokens += len(value) // self.id_bytes
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _write(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.sink.write(data)
        self.at += len(data)
        return at, len(data)

    def _end_block(self) -> None:
        if self.block:
            at, size = self._write(bytes(self.block) + struct.pack("<I", zlib.crc32(self.block)))
            self.index += struct.pack("<H", len(self.first)) + self.first + _INDEX.pack(at, size)
            self.block = bytearray()

    def close(self) -> None:
        self._end_block()
        index = self._write(bytes(self.index))
        bits = max(64, BLOOM_BITS * self.entries)
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for stem in dict.fromkeys(self.stems):
            for p in _probes(stem, bits, BLOOM_PROBES):
                bloom[p >> 3] |= 1 << (p & 7)
        filters = self._write(struct.pack("<QI", bits, BLOOM_PROBES) + bloom.tobytes())
        self._write(_FOOTER.pack(*index, *filters, self.entries, self.tokens, self.id_bytes, _MAGIC))


class Table:
    """Read a shard: look documents up by id, or go through all of them in key order."""

    def __init__(self, file):
        self.file = file
        end = file.size() if callable(getattr(file, "size", None)) else file.seek(0, 2)
        index, index_size, bloom, bloom_size, self.entries, self.tokens, self.id_bytes, magic = _FOOTER.unpack(self._read(end - _FOOTER.size, _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        self.firsts: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        raw, at = self._read(index, index_size), 0
        while at < len(raw):
            (n,) = struct.unpack_from("<H", raw, at)
            self.firsts.append(raw[at + 2 : at + 2 + n])
            self.places.append(_INDEX.unpack_from(raw, at + 2 + n))
            at += 2 + n + _INDEX.size
        raw = self._read(bloom, bloom_size)
        self.bits, self.probes = struct.unpack_from("<QI", raw)
        self.bloom = raw[12:]

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        raw = self._read(*self.places[i])
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        at, key = 0, b""
        while at < len(raw) - 4:
            shared, rest, size = _ENTRY.unpack_from(raw, at)
            at += _ENTRY.size
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.places)):
            yield from self._block(i)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id)[:9], self.bits, self.probes))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each entry with this document id: Bloom filter, then binary search of the block index."""
        if not self.may_hold(doc_id):
            return []
        stem, found = key_of(doc_id)[:9], []
        i = max(0, bisect.bisect_left(self.firsts, stem) - 1)
        while i < len(self.firsts) and self.firsts[i][:9] <= stem:
            found += [self.ids(v) for k, v in self._block(i) if k[:9] == stem]
            i += 1
        return found

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.id_bytes}").astype("<u4")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it, for a local path or a URI."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_shards(docs: DataFrame, tokenizer: bytes, end_id: int, path: str, shard_text_bytes: int = SHARD_TEXT_BYTES) -> DataFrame:
    """Encode every document, append ``end_id`` and write shards under ``path`` in ascending doc_id order.

    Returns the manifest, one row per shard in order: (shard, file, n_docs, n_tokens).  A null text is empty and so has
    the end id alone; null ids come first; rows that repeat are kept, each with an entry.  A shard is written under a
    name of its attempt and then renamed, so a task that runs again leaves one whole file.  An empty table has no shard.
    """
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(tokenizer)
    src = id_and_text(docs).withColumn("place", F.monotonically_increasing_id())
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(2 * spark.sparkContext.defaultParallelism, -(-size // shard_text_bytes))
    dealt = src.repartitionByRange(shards, "doc_id", "place").sortWithinPartitions("doc_id", "place")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = opened(file.value), TaskContext.get()
        end = end_id.to_bytes(2 if bpe.code == "H" else 4, "little")
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        shard = task.partitionId()
        name, own = f"{root}/shard-{shard:07d}.sst", f"{root}/.shard-{shard:07d}-{task.taskAttemptId()}"
        writer = None
        sink = None
        for batch in batches:
            for part in slices(batch):
                if writer is None:
                    sink = fs.open_output_stream(own)
                    writer = Writer(sink, len(end))
                for doc_id, text, place in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "place")), strict=True):
                    writer.add(key_of(doc_id, place), bpe.encode(text) + end)
                bpe.trim()
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(own, name)
            row = [[shard], [f"{path}/shard-{shard:07d}.sst"], [writer.entries], [writer.tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1]), pa.array(row[2], pa.int64()), pa.array(row[3], pa.int64())], ["shard", "file", "n_docs", "n_tokens"])

    return dealt.mapInArrow(write, "shard int, file string, n_docs long, n_tokens long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry, read from the files of a written manifest.

    ``start`` counts the ids of all documents before: the sum over the shards before (one small row each) and within
    the shard.  ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers.
    """
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spark = manifest.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, name = filesystem(path)
                ids: list[int | None] = []
                starts: list[int] = []
                sizes: list[int] = []
                crcs: list[int] = []
                with fs.open_input_file(name) as f:
                    table = Table(f)
                    for key, value in table:
                        tokens = table.ids(value)
                        ids.append(id_of(key))
                        starts.append(base)
                        sizes.append(len(tokens))
                        crcs.append(zlib.crc32(tokens.tobytes()))
                        base += len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, sizes, crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("shard", "file", "base").repartitionByRange(tasks, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer: bytes, end_id: int = 2) -> DataFrame:
    """Write shards to the shared folder and return what ``read_shards`` reads from them."""
    spark: SparkSession = docs.sparkSession
    manifest = written(write_shards(docs, tokenizer, end_id, new_path(spark, "sst")), "sst-manifest")
    return read_shards(manifest)
