"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

Layout of a file: zstandard frames of little-endian unsigned 32-bit ids of consecutive documents; a
skippable frame with the document index (a compressed Arrow stream: doc_id, start, n_tokens, where start
counts ids from the file's beginning); a skippable frame with a seek table in the public seekable format
(compressed size, decompressed size and low 32 bits of the frame's xxh64, for each frame; then the number of
frames, a descriptor byte and the magic number). A reader takes the last bytes, the index and only those
frames that hold the documents asked for, and checks each frame's checksum.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import filesystem, in_batches, scratch, slices, text_bytes, written
from lodestrata.llm.token_ids import vocabulary, word_tokens
from lodestrata.session import table

FRAME_BYTES = 1 << 20
# fixed values: of the public seekable format
SKIP_INDEX, SKIP_TABLE, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Writes one file; memory is one frame and three integers a document."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import xxhash
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.packer, self.hash = zstandard.ZstdCompressor(level=level), xxhash.xxh64_intdigest
        self.held, self.table, self.ids = bytearray(), [], 0
        self.index: list[list] = [[], [], []]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        for column, v in zip(self.index, (doc_id, self.ids, len(ids) // 4), strict=True):
            column.append(v)
        self.ids += len(ids) // 4
        self.held += ids
        while len(self.held) >= self.frame_bytes:
            self.frame(self.frame_bytes)

    def frame(self, n: int) -> None:
        raw = bytes(self.held[:n])
        del self.held[:n]
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), self.hash(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.held:
            self.frame(len(self.held))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, INDEX) as w:
            w.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in self.index], schema=INDEX))
        index = self.packer.compress(sink.getvalue().to_pybytes())
        self.out.write(struct.pack("<II", SKIP_INDEX, len(index)) + index)
        rows = b"".join(struct.pack("<III", *x) for x in self.table)
        self.out.write(struct.pack("<II", SKIP_TABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE))


class ShardReader:
    """Reads documents of one file; only the frames that hold them are decompressed."""

    def __init__(self, source):
        import xxhash
        import zstandard

        self.source, self.hash = source, xxhash.xxh64_intdigest
        self.unpacker = zstandard.ZstdDecompressor()
        size = source.size()
        n, _, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        rows = self.at(size - 9 - 12 * n, 12 * n)
        self.frames, place, start = [], 0, 0
        for i in range(n):
            packed, raw, check = struct.unpack_from("<III", rows, 12 * i)
            self.frames.append((place, packed, start, raw, check))
            place, start = place + packed, start + raw
        kind, length = struct.unpack("<II", self.at(place, 8))
        if kind != SKIP_INDEX:
            raise ValueError("no document index before the seek table")
        stream = self.unpacker.decompress(self.at(place + 8, length), max_output_size=1 << 40) if length else b""
        self.index = pa.ipc.open_stream(stream).read_all()
        self.last: tuple[int, bytes] = (-1, b"")

    def at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            place, packed, _, raw, check = self.frames[i]
            data = self.unpacker.decompress(self.at(place, packed), max_output_size=raw)
            if self.hash(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {i} does not match its checksum")
            self.last = (i, data)
        return self.last[1]

    def ids(self, start: int, n: int) -> bytes:
        """n ids from the start-th of the file, as bytes."""
        import bisect

        lo, hi, out = 4 * start, 4 * (start + n), []
        i = max(0, bisect.bisect_right(self.frames, lo, key=lambda f: f[2]) - 1)
        while lo < hi:
            _, _, first, raw, _ = self.frames[i]
            out.append(self.frame(i)[lo - first : hi - first])
            lo, i = first + raw, i + 1
        return b"".join(out)

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, int, bytes]]:
        """doc_id, start, n_tokens and the ids' bytes, of all documents or of those wanted."""
        for chunk in self.index.to_batches(max_chunksize=4096):
            for doc, start, n in zip(*(c.to_pylist() for c in chunk.columns), strict=True):
                if wanted is None or doc in wanted:
                    yield doc, start, n, self.ids(start, n)


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes docs (doc_id, text) as files in ascending doc_id order; returns shard, path, n_docs, n_ids.

    Null text is empty; a null doc_id comes first; repeated ids stay, ordered by text. Each file appears by
    a rename once it is whole, so a task that runs again replaces it with the same bytes.
    """
    path = path or vocabulary()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, tokens, end = TaskContext.get().partitionId(), word_tokens(path), struct.pack("<I", end_id)
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        name, part, docs_n, writer, out = f"{at}/shard-{shard:06d}.tok", f"{at}/.{uuid.uuid4().hex}", 0, None, None
        for batch in slices(iter(batches)):
            if writer is None:
                out = fs.open_output_stream(part)
                writer = ShardWriter(out)
            for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                writer.add(doc, tokens.encode(text) + end)
                docs_n += 1
        if writer is not None:
            writer.close()
            out.close()
            fs.move(part, name)
            row = [[shard], [f"{folder}/shard-{shard:06d}.tok"], [docs_n], [writer.ids]]
            yield pa.record_batch([pa.array(c) for c in row], ["shard", "path", "n_docs", "n_ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return in_batches(ordered, write, "shard long, path string, n_docs long, n_ids long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files of a manifest."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("path", before.alias("before"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as source:
                    rows: list[list] = [[], [], [], []]
                    for doc, start, n, ids in ShardReader(source).documents():
                        for column, v in zip(rows, (doc, first + start, n, zlib.crc32(ids)), strict=True):
                            column.append(v)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents` written as token files and read back."""
    manifest = written(write_shards(table(spark, sf_dir, "documents"), scratch(spark, "tokens")), "manifest")
    return read_shards(manifest)
