"""Token-id files: independent zstandard frames, a trailing seek table and a checksum for each frame.

A file is frames, then a skippable frame with the first and last document of each frame, then a skippable frame with the
seek table of the public seekable format (compressed size, size, low half of XXH64 for each frame; count, flags, magic).
A reader loads the two tables from the end and decompresses only the frames whose documents are asked for.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir
from .tokens import END_ID, encoder, released

SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Ids after which a frame ends.
FRAME_IDS = 1 << 17


class TokenFileWriter:
    """Appends documents in the order given; close() writes the tables. sink: an open binary file."""

    def __init__(self, sink, level: int = 3, frame_ids: int = FRAME_IDS):
        import zstandard

        self.sink, self.packer, self.frame_ids = sink, zstandard.ZstdCompressor(level=level), frame_ids
        self.keys: list[int | None] = []
        self.docs: list[np.ndarray] = []
        self.held = self.bytes = 0
        self.seek: list[bytes] = []
        self.index: list[bytes] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.keys.append(doc_id)
        self.docs.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_ids:
            self._frame()

    def _frame(self) -> None:
        import xxhash

        if not self.keys:
            return
        n, ids = len(self.keys), np.concatenate(self.docs).astype("<u4")
        wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
        raw = b"".join((
            struct.pack("<IB", n, 4 if wide else 2),
            np.array([k is None for k in self.keys], dtype="u1").tobytes(),
            np.array([k or 0 for k in self.keys], dtype="<i8").tobytes(),
            np.array([len(x) for x in self.docs], dtype="<u4").tobytes(),
            ids.astype("<u4" if wide else "<u2").tobytes(),
        ))
        packed = self.packer.compress(raw)
        self.sink.write(packed)
        self.bytes += len(packed)
        self.seek.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        least, most = (k if k is not None else -(1 << 63) for k in (self.keys[0], self.keys[-1]))
        self.index.append(struct.pack("<qqI", least, most, n))
        self.keys, self.docs, self.held = [], [], 0

    def close(self) -> None:
        self._frame()
        index = b"".join(self.index) + struct.pack("<I", len(self.index))
        seek = b"".join(self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEK_MAGIC)
        for body in (index, seek):
            self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
            self.bytes += 8 + len(body)


class TokenFileReader:
    """Random access to one file. source: an open binary file with seek, read and a known size."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * n)
        self.seek = np.frombuffer(source.read(12 * n), dtype="<u4").reshape(-1, 3)
        at = size - 9 - 12 * n - 8 - 4 - 20 * n
        source.seek(at)
        self.index = np.frombuffer(source.read(20 * n), dtype=[("least", "<i8"), ("most", "<i8"), ("n", "<u4")])
        self.starts = np.concatenate([[0], np.cumsum(self.seek[:, 0], dtype=np.int64)])

    def frame(self, k: int) -> list[tuple[int | None, np.ndarray]]:
        """The documents of frame k, after its checksum held."""
        import xxhash
        import zstandard

        self.source.seek(int(self.starts[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.seek[k, 0])), max_output_size=int(self.seek[k, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        n, width = struct.unpack_from("<IB", raw)
        null = np.frombuffer(raw, "u1", n, 5)
        keys = np.frombuffer(raw, "<i8", n, 5 + n).tolist()
        lens = np.frombuffer(raw, "<u4", n, 5 + 9 * n)
        ids = np.frombuffer(raw, f"<u{width}", offset=5 + 13 * n).astype("<u4")
        cuts = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        return [(None if null[i] else keys[i], ids[cuts[i] : cuts[i + 1]]) for i in range(n)]

    def __iter__(self):
        for k in range(len(self.seek)):
            yield from self.frame(k)

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document with this id; only frames that can hold it are decompressed."""
        hit = np.flatnonzero((self.index["least"] <= doc_id) & (doc_id <= self.index["most"]))
        return [ids for k in hit for key, ids in self.frame(int(k)) if key == doc_id]


def opened(uri: str):
    """The file system and the path in it that a URI names (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> list[dict]:
    """Encodes docs and writes them to folder in ascending id order, a file for each range of ids.

    Null ids come first, null texts are empty, equal ids stay as rows of their own. Returns the manifest in that order, one
    small record a file. A task that is run again writes a file of another name, and the manifest names the one that counts.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        name = f"{base}/tokens-{task.partitionId():06d}-{task.taskAttemptId()}.tokens"
        n_docs = n_ids = 0
        writer = sink = None
        for batch in batches:
            encode = encoder(tokenizer)
            if writer is None:
                sink = system.open_output_stream(name, compression=None)
                writer = TokenFileWriter(sink)
            keys = batch.column(0).to_pylist()
            for at in range(0, len(keys), 1000):
                texts = batch.column(1).slice(at, 1000).to_pylist()
                for key, ids in zip(keys[at : at + 1000], encode.ids(texts), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    writer.add(key, ids)
                    n_docs, n_ids = n_docs + 1, n_ids + len(ids)
        released()
        if writer is not None:
            writer.close()
            sink.close()
            yield _batch({"part": [task.partitionId()], "path": [name], "docs": [n_docs], "ids": [n_ids], "bytes": [writer.bytes]}, "part: int, path: string, docs: long, ids: long, bytes: long")

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return [r.asDict() for r in sorted(rows.mapInArrow(write, "part int, path string, docs long, ids long, bytes long").collect())]


def read_token_files(spark, folder: str, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files that manifest names."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    starts = np.concatenate([[0], np.cumsum([m["ids"] for m in manifest])]).tolist()

    def read(batches):
        for batch in batches:
            system, _ = opened(folder)
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(path) as source:
                    out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                    for key, ids in TokenFileReader(source, source.size()):
                        for k, v in zip(out, (key, start, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                            out[k].append(v)
                        start += len(ids)
                    yield _batch(out, schema.replace(" ", ": ").replace(",: ", ", "))

    named = spark.createDataFrame([(m["path"], s) for m, s in zip(manifest, starts, strict=False)], "path string, start long")
    return named.repartition(len(manifest)).mapInArrow(read, schema)


def _batch(columns: dict[str, list], schema: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [x.split(": ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[k], kinds[t]) for k, t in fields], [k for k, _ in fields])


def token_file_folder(spark) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/lodestone/tokens-{uuid.uuid4().hex}"


def local_reader(path: str) -> TokenFileReader:
    """A reader of a file on this machine."""
    return TokenFileReader(open(path, "rb"), os.path.getsize(path))
