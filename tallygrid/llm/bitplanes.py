"""Token ids in binary files: fixed-size id blocks transposed into bit or byte planes, each plane compressed.

File layout, all numbers little-endian::

    "TGBP" | version u8 | mode u8 | reserved u16
    chunks, each the compressed planes of one block of ids, lowest plane first
    footer: JSON {"block", "chunks": [[offset, n_ids, crc32, [plane bytes...]]...], "docs": n}, then the
        document index (doc_id i64, valid u8, n_tokens i64 columns), both zstandard frames
    footer bytes u64 | index bytes u64 | "TGBP"

A plane with only zeros takes no bytes. Readers find any chunk through the chunk index.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallygrid.llm.encoding import encoder
from tallygrid.llm.shared import fresh_path, reach_workers, text_key, written

MAGIC, VERSION = b"TGBP", 1
BLOCK = 1 << 16
MODES = ("byte", "bit")
#: Bytes of ids in one Arrow batch that a reader hands on.
BATCH_BYTES = 4 << 20


def planes_of(ids: np.ndarray, mode: str) -> list[bytes]:
    """A block of unsigned 32-bit ids as 4 byte planes or 32 bit planes, lowest first."""
    cells = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [np.ascontiguousarray(cells[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(cells, axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return [row.tobytes() for row in packed]


def ids_of(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    """The inverse of :func:`planes_of`; an empty plane stands for zeros."""
    if mode == "byte":
        cells = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                cells[:, k] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.zeros((32, n), np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                bits[k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        cells = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return cells.reshape(-1).view("<u4")


class PlaneWriter:
    """Streams ids of one ordered run of documents into one file; holds one block and the document index."""

    def __init__(self, sink, mode: str = "byte", block: int = BLOCK, level: int = 3) -> None:
        self.sink, self.mode, self.block = sink, mode, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at, self.waiting, self.held = 8, [], 0
        self.chunks: list = []
        self.docs: list[tuple[int | None, int]] = []
        sink.write(MAGIC + struct.pack("<BBH", VERSION, MODES.index(mode), 0))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids.astype("<u4"))
        self.held += len(ids)
        if self.held >= self.block:
            all_ids = np.concatenate(self.waiting)
            whole = self.held - self.held % self.block
            for k in range(0, whole, self.block):
                self._chunk(all_ids[k : k + self.block])
            self.waiting, self.held = [all_ids[whole:]], self.held - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.pack(p) if any(p) else b"" for p in planes_of(ids, self.mode)]
        self.sink.write(b"".join(planes))
        self.chunks.append([self.at, len(ids), zlib.crc32(ids.tobytes()), [len(p) for p in planes]])
        self.at += sum(map(len, planes))

    def close(self) -> None:
        if self.held:
            self._chunk(np.concatenate(self.waiting))
        n = len(self.docs)
        index = np.fromiter((d or 0 for d, _ in self.docs), "<i8", n).tobytes() + np.fromiter((d is not None for d, _ in self.docs), np.uint8, n).tobytes() + np.fromiter((k for _, k in self.docs), "<i8", n).tobytes()
        footer = self.pack(json.dumps({"block": self.block, "chunks": self.chunks, "docs": n}).encode())
        index = self.pack(index)
        self.sink.write(footer + index + struct.pack("<QQ", len(footer), len(index)) + MAGIC)


class PlaneReader:
    """Random access to the chunks of one file, and its documents in order."""

    def __init__(self, source) -> None:
        self.source = source
        self.unpack = zstandard.ZstdDecompressor().decompress
        source.seek(0)
        head = source.read(8)
        size = source.size()
        source.seek(size - 20)
        n_footer, n_index, magic = struct.unpack("<QQ4s", source.read(20))
        if head[:4] != MAGIC or magic != MAGIC or head[4] != VERSION:
            raise ValueError("not a file of token id planes")
        self.mode = MODES[head[5]]
        source.seek(size - 20 - n_footer - n_index)
        self.footer = json.loads(self.unpack(source.read(n_footer)))
        raw, n = self.unpack(source.read(n_index)), self.footer["docs"]
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.valid = np.frombuffer(raw, np.uint8, n, 8 * n)
        self.lengths = np.frombuffer(raw, "<i8", n, 9 * n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, crc, sizes = self.footer["chunks"][k]
        self.source.seek(at)
        planes = [self.unpack(self.source.read(size)) if size else b"" for size in sizes]
        ids = ids_of(planes, n, self.mode)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        ready, k = np.zeros(0, "<u4"), 0
        for doc_id, valid, n in zip(self.doc_ids.tolist(), self.valid.tolist(), self.lengths.tolist(), strict=True):
            parts, have = [ready], len(ready)
            while have < n:
                parts.append(self.chunk(k))
                have, k = have + len(parts[-1]), k + 1
            ids = np.concatenate(parts) if len(parts) > 1 else ready
            yield (doc_id if valid else None), ids[:n]
            ready = ids[n:]


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, mode: str = "byte", block: int = BLOCK) -> DataFrame:
    """Encode the whole texts of ``docs`` (doc_id, text) and write their ids, in ascending doc_id order, to files in ``folder``.

    Each document's ids are followed by ``end_id``. Returns the manifest: file_no, file, n_docs, n_ids, one
    row per file in order. The rows are range-partitioned by doc_id, so file after file holds the order.
    A task writes a file of a new name and only names in the manifest count, so repeated tasks do no harm.
    Null text counts as empty; a null doc_id comes first; repeated ids stay, ordered by a hash of their text;
    an empty table gives no rows. Other columns are ignored.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    reach_workers(docs.sparkSession)
    order = ("doc_id", "tie")
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", text_key()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        encode, out, sink = encoder(tokenizer), None, None
        number, n_ids = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            for at in range(0, len(doc_ids), 256):
                if out is None:
                    store, where = fs.FileSystem.from_uri(folder)
                    store.create_dir(where, recursive=True)
                    name = f"ids-{number:06d}-{uuid.uuid4().hex}.tgbp"
                    sink = store.open_output_stream(f"{where}/{name}")
                    out = PlaneWriter(sink, mode, block)
                for doc_id, ids in zip(doc_ids[at : at + 256], encode.encode(texts.slice(at, 256).to_pylist()), strict=True):
                    found = np.append(np.frombuffer(ids, encode.dtype).astype("<u4"), np.uint32(end_id))
                    out.add(doc_id, found)
                    n_ids += len(found)
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([number], pa.int64()), "file": pa.array([f"{folder}/{name}"]), "n_docs": pa.array([len(out.docs)], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    return written(ranged.mapInArrow(write, "file_no long, file string, n_docs long, n_ids long"), "manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Read the files of :func:`write_ids` back: doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit).

    Each file is read by one task, chunk by chunk; the offsets of files come from a running sum over the manifest.
    """
    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n_files = max(1, manifest.count())
    files = manifest.select("file_no", "file", base.alias("base")).repartitionByRange(n_files, "file_no").select("file", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def batch(rows):
            doc_ids, starts, counts, ids = zip(*rows, strict=True)
            return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(ids, pa.binary())})

        for given in batches:
            for file, start in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True):
                store, where = fs.FileSystem.from_uri(file)
                rows, held = [], 0
                with store.open_input_file(where) as source:
                    for doc_id, ids in PlaneReader(source).documents():
                        rows.append((doc_id, start, len(ids), ids.tobytes()))
                        start, held = start + len(ids), held + 4 * len(ids)
                        if held >= BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op1_bit_plane_ids(spark, sf_dir: str) -> DataFrame:
    """``documents`` encoded, written as byte planes and read back; one row per document."""
    import public_tokenizers

    from tallygrid.llm.shared import read_table

    manifest = write_ids(read_table(spark, sf_dir, "documents"), fresh_path(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_ids(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
