"""Bounded-space best-fit packing of token sequences.

Each partition keeps a fixed number of open windows. A document's whole windows go out at once; its rest goes to the open
window where it leaves the least room. When none has room, the fullest is filled by cutting the rest there, and goes out.
What is still open at a partition's end is merged by the same rule in a tree, some partitions at a time.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, lean
from .tokens import END_ID, encoder, released

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"


class Packer:
    """windows: how many stay open, the bound on memory. put() and flush() return finished windows as lists of pieces."""

    def __init__(self, size: int = 4096, windows: int = 32):
        self.size, self.windows = size, windows
        self.open: dict[int, list] = {}
        self.rooms: list[tuple[int, int]] = []
        self.made = 0

    def put(self, doc_id, ids: np.ndarray, start: int, total: int) -> list[list]:
        """start: the document's ids before these; total: all its ids."""
        out, at = [], 0
        while len(ids) - at >= self.size:
            out.append([(doc_id, start + at, ids[at : at + self.size], total)])
            at += self.size
        while at < len(ids):
            need = len(ids) - at
            k = bisect_left(self.rooms, (need, -1))
            if k < len(self.rooms):
                room, w = self.rooms.pop(k)
            elif len(self.rooms) < self.windows:
                room, w, self.made = self.size, self.made, self.made + 1
                self.open[w] = []
            else:
                room, w = self.rooms.pop(0)
            n = min(need, room)
            self.open[w].append((doc_id, start + at, ids[at : at + n], total))
            at += n
            if room == n:
                out.append(self.open.pop(w))
            else:
                insort(self.rooms, (room - n, w))
        return out

    def flush(self) -> list[list]:
        """The open windows, fullest first."""
        left = [self.open.pop(w) for _, w in self.rooms]
        self.rooms = []
        return left


def _rows(windows: list[list], first: int, part: int | None) -> dict[str, list]:
    """Columns of SCHEMA. With part, windows are open and their ids go along."""
    out: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")}
    for n, pieces in enumerate(windows):
        offset = 0
        for doc_id, start, ids, total in pieces:
            raw = ids.tobytes()
            for k, v in zip(out, (doc_id, start, len(ids), zlib.crc32(raw), total, first + n, offset, part, raw if part is not None else None), strict=True):
                out[k].append(v)
            offset += len(ids)
    return out


def _arrow(columns: dict[str, list]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in columns.items()], list(columns))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, windows: int = 32, end_id: int = END_ID, fan_in: int = 32) -> DataFrame:
    """One row for each piece of a document: where it starts, its length and checksum, its sequence and its place there.

    Null and empty texts are documents of the end id alone; equal and null ids stay rows of their own. An empty table gives
    no rows. Every id lies in exactly one piece; only the very last sequence is shorter than size.
    """

    def first(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, made = Packer(size, windows), 0
        for batch in lean(batches):
            encode, keys = encoder(tokenizer), batch.column(0).to_pylist()
            for at in range(0, len(keys), 1000):
                done: list[list] = []
                for key, ids in zip(keys[at : at + 1000], encode.ids(batch.column(1).slice(at, 1000).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    done += packer.put(key, ids, 0, len(ids))
                if done:
                    yield _arrow(_rows(done, (part << 30) + made, None))
                    made += len(done)
        released()
        if left := packer.flush():
            yield _arrow(_rows(left, 0, part))

    def merge(level: int, last: bool):
        def merged(key, frame):
            import pandas as pd

            packer, done = Packer(size, 1 if last else windows), []
            for r in frame.sort_values(["part", "sequence_id", "offset"]).itertuples():
                done += packer.put(None if pd.isna(r.doc_id) else int(r.doc_id), np.frombuffer(r.ids, "<u4"), int(r.start), int(r.doc_tokens))
            left = packer.flush()
            if last:
                done, left = done + left, []
            first_id = (level << 58) + (int(key[0]) << 30)
            out = [pd.DataFrame(_rows(done, first_id, None), dtype=object), pd.DataFrame(_rows(left, 0, int(key[0])), dtype=object)]
            return pd.concat([x for x in out if len(x)])

        return merged

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    state = cut(rows.mapInArrow(first, SCHEMA))
    done = [state.filter("part is null")]
    parts, level = (state.agg(F.max("part")).head()[0] or 0) + 1, 0
    while True:
        level, last = level + 1, parts <= fan_in
        left = state.filter("part is not null").withColumn("group", F.expr(f"part div {fan_in}"))
        state = cut(left.groupBy("group").applyInPandas(merge(level, last), SCHEMA))
        done.append(state.filter("part is null"))
        if last:
            break
        parts = -(-parts // fan_in)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("part", "ids")
