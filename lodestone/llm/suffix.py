"""Removal of long repeated passages by bucket-pointer refinement, on sampled suffixes first.

Two suffixes repeat a passage if they stay in one bucket until its whole length is sorted. Initial buckets are those of the
8-byte grams (a bucket's identifier is the gram, mixed). Refinement doubles the depth: a suffix's bucket at depth 2d is named
by its bucket at d and the bucket at d of the suffix d bytes later, and these names are the pointers of the next round, so
every round reuses what the one before updated; the last one takes the later offset that ends at the depth asked for.
Identifiers come from contents, so every worker derives the same ones, and equal identifiers meet in a shuffle. Suffixes
alone in their bucket are done.

To sort only few suffixes, the starts of a document are put in runs that share an anchor, the least gram in the window of
starts from each, about half the length wide (so a passage has the same anchors wherever it stands). Refinement then goes in
three passes, each over the buckets that the one before left open:
1. anchors, to the other half of the length: alone in its bucket, none of the anchor's run repeats; equal runs repeat as a whole;
2. cells of 16 starts at fixed distances from the anchor, by what their strings have in common and then by all of a cell;
3. single starts, by the up to 15 bytes before and after a cell's common part.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, byte_view, cut, discard, fetched, lean, mix, randoms

CELL, GRAM = 16, 8
#: Starts of a document that are worked on at a time.
CHUNK = 1 << 20
#: Factors of a bucket's own and of the later bucket's name, for two independent names.
_OWN, _LATER = randoms(2, 21), randoms(2, 7021)


class Suffixes:
    """Runs and cells of one text's starts, for repeated strings of length bytes."""

    def __init__(self, length: int):
        if length < 64:
            raise ValueError("length is 64 or more")
        self.length = length
        self.window = (length - GRAM) // 2
        self.depth = length - self.window + 1
        self.core = length - CELL + 1

    @staticmethod
    def grams(data: np.ndarray) -> np.ndarray:
        """The identifier of the initial bucket of each suffix that has GRAM bytes."""
        n = len(data) - GRAM + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix(np.lib.stride_tricks.as_strided(data, (n, GRAM), (1, 1)).copy().view("<u8")[:, 0])

    @staticmethod
    def refined(grams: np.ndarray, starts: np.ndarray, depth: int, second: bool = False) -> np.ndarray:
        """Identifiers of the buckets at depth: rounds of (own bucket, bucket at the later offset), the offset doubling."""
        own, later = _OWN[int(second)], _LATER[int(second)]
        most = GRAM
        while 2 * most <= depth:
            most *= 2
        out, at = np.empty(len(starts), np.uint64), np.arange(0, most, GRAM)
        for i in range(0, len(starts), 4096):
            # The suffixes that the rounds point to: every GRAM bytes up to most, from the start and from the last offset.
            here = starts[i : i + 4096, None]
            bucket = grams[np.stack([here + at, here + (depth - most) + at], axis=1)]
            while bucket.shape[2] > 1:
                bucket = mix(bucket[:, :, ::2] * own + bucket[:, :, 1::2] * later)
            out[i : i + 4096] = mix(bucket[:, 0, 0] * own + bucket[:, 1, 0] * later + np.uint64(depth))
        return out

    def runs(self, data: np.ndarray, whole: bool = True):
        """(anchor, first start, last start, bucket, identity of the run's text if whole) of every run, as arrays, a chunk at a time."""
        total = len(data) - self.length + 1
        for at in range(0, total, CHUNK):
            n = min(CHUNK, total - at)
            grams = self.grams(data[at : at + n + self.length - 1])
            wide, m = self.window, n + self.window - 1
            # The least of each window's values, by running minima from both ends of blocks; the place breaks ties.
            v = (grams[:m] & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
            v = np.concatenate([v, np.full(-m % wide, np.uint64(2**64 - 1))]).reshape(-1, wide)
            up = np.minimum.accumulate(v, axis=1).ravel()
            down = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
            anchor = (np.minimum(down[:n], up[wide - 1 : wide - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            last = np.append(first[1:], n) - 1
            a = anchor[first]
            bucket = self.refined(grams, a, self.depth)
            if not whole:
                yield a + at, first + at, last + at, bucket, None
                continue
            ends = self.refined(grams, first, self.length) + mix(self.refined(grams, last, self.length) + np.uint64(1))
            text = mix(ends + mix(((a - first) << 20 | (last - first)).astype(np.uint64)))
            yield a + at, first + at, last + at, bucket, text

    def cells(self, data: np.ndarray, runs: np.ndarray):
        """For rows (anchor, first, last, weight): columns (base, far, near, k1, k2, weight) of their cells. Starts base - far to base - near."""
        a, first, last, weight = runs.T
        least = (a - last) // CELL
        many = (a - first) // CELL - least + 1
        r = np.repeat(np.arange(len(a)), many)
        c = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many) + least[r]
        base = a[r] - CELL * c
        far, near = np.minimum(base - first[r], CELL - 1), np.maximum(base - last[r], 0)
        for at in range(0, len(r), 4096):
            s = slice(at, at + 4096)
            lo = int(base[s].min())
            grams = self.grams(data[lo : int(base[s].max()) + self.core])
            tag = mix(c[s].astype(np.uint64))
            k1, k2 = (mix(self.refined(grams, base[s] - lo, self.core, x) + tag) for x in (False, True))
            yield base[s], far[s], near[s], k1, k2, weight[r][s]


#: What tells rows apart: 128 bits of hash of id and text.
ROW = ["row", "row2"]
_ROW_TYPE = "row long, row2 long"


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("row2", F.xxhash64(F.lit("second"), "text", "doc_id"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, carry: tuple[str, ...] = (), keep: str = "bytes", min_words: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept for each row of docs.

    keep: kept holds the remaining "bytes", or them as "text" (a character cut at an edge of a removed run goes whole), or "none".

    A byte goes if it lies in a string of length bytes (64 or more) that starts at another place of the input too; overlaps
    count. min_words: a run of such bytes stays if it has fewer words or parts of words (parted by [\\x20\\x09-\\x0D]). carry: further columns that rows keep, under their own names; one named like a result gets "_in" behind it. Null
    texts are empty, an empty table gives no rows. Equal and null ids stay rows of their own; repeated rows repeat each other.
    Texts may be of any length, CHUNK starts of them are worked on at a time. Strings and rows are told apart by 128 bits of hash.
    """
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    work = Suffixes(length)
    given = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    base = _keyed(docs.select(*given))
    held = [f"carry_{i}" for i in range(len(carry))]
    whole_rows = _keyed(docs.select(*given, *[F.col(f"`{c}`").alias(h) for c, h in zip(carry, held, strict=True)]))
    # Texts too short for a repeat stay out of the passes.
    long_enough = base.filter(F.octet_length("text") >= length)

    def find_buckets(batches):
        for batch in lean(batches):
            data, offsets = byte_view(batch.column("text"))
            held = [bucket for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for *_, bucket, _ in work.runs(data[lo:hi], whole=False)]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["bucket"])

    def find_runs(batches):
        names = ["bucket", "text", *ROW, "anchor", "first", "last"]
        for batch in lean(batches):
            keys = zip(*[batch.column(c).to_pylist() for c in ROW], strict=True)
            data, offsets = byte_view(batch.column("text"))
            held, n = [], 0
            for (key, key2), lo, hi in zip(keys, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for a, first, last, bucket, text in work.runs(data[lo:hi]):
                    held.append((bucket.view(np.int64), text.view(np.int64), np.full(len(a), key), np.full(len(a), key2), a, first, last))
                    n += len(a)
                if n > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)
                    held, n = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)

    runs = long_enough.mapInArrow(find_runs, f"bucket long, text long, {_ROW_TYPE}, anchor long, first long, last long")
    # The buckets of more than one suffix, written first: a join of two plain shuffles can be split where it is skewed.
    shared = cut(long_enough.select("text").mapInArrow(find_buckets, "bucket long").groupBy("bucket").count().filter("count > 1").select("bucket"))
    runs = cut(runs.join(shared, "bucket", "left_semi"))
    discard(shared)
    # Pass 1. Equal runs of one bucket are one class.
    classes = cut(runs.groupBy("bucket", "text").agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "anchor", "first", "last")).alias("r")))
    open_buckets = classes.groupBy("bucket").agg(F.count("*").alias("n"), F.min("n").alias("least")).filter("n > 1 and least = 1").select("bucket")
    whole = runs.join(classes.filter("n > 1").select("bucket", "text"), ["bucket", "text"], "left_semi").select(*ROW, "first", "last")
    left = classes.join(open_buckets, "bucket", "left_semi").select("r.*", F.least("n", F.lit(2)).alias("weight"))
    left = cut(left.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("anchor", "first", "last", "weight"))).alias("runs")))

    def find_cells(batches):
        names = ["k1", "k2", *ROW, "base", "far", "near", "before", "after", "weight"]
        for batch in lean(batches):
            data, offsets = byte_view(batch.column("text"))
            keys, lists = list(zip(*[batch.column(c).to_pylist() for c in ROW], strict=True)), batch.column("runs")
            flat, cuts = lists.flatten(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            table = np.stack([flat.field(i).to_numpy() for i in range(4)], axis=1).astype(np.int64)
            for i, (key, key2) in enumerate(keys):
                text = data[offsets[i] : offsets[i + 1]]
                raw = text.tobytes()
                for b, far, near, k1, k2, w in work.cells(text, table[cuts[i] : cuts[i + 1]]):
                    before = [raw[x - f : x] for x, f in zip(b.tolist(), far.tolist(), strict=True)]
                    after = [raw[x + work.core : x - n + length] for x, n in zip(b.tolist(), near.tolist(), strict=True)]
                    same_key = [pa.array(np.full(len(b), k)) for k in (key, key2)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), *same_key, pa.array(b), pa.array(far), pa.array(near), pa.array(before, pa.binary()), pa.array(after, pa.binary()), pa.array(w)],
                        names,
                    )

    # Pass 2. A class of a run stands for all its members, so its weight is 2 if it has more than one.
    cells = fetched(long_enough, left, ROW).select(*ROW, "text", "runs")
    cells = cut(cells.mapInArrow(find_cells, f"k1 long, k2 long, {_ROW_TYPE}, base long, far long, near long, before binary, after binary, weight long"))
    discard(left)
    cell = ["k1", "k2", "before", "after", "near", "far"]
    same = cut(cells.groupBy(*cell).agg(F.sum("weight").alias("n"), F.min(F.struct(*ROW, "base")).alias("r")))
    repeated = same.filter("n > 1").select(*cell)
    in_cells = cells.filter("weight = 1").join(repeated, cell, "left_semi").select(*ROW, (F.col("base") - F.col("far")).alias("first"), (F.col("base") - F.col("near")).alias("last"))
    mixed = same.groupBy("k1", "k2").agg(F.count("*").alias("c"), F.min("n").alias("least")).filter("c > 1 and least = 1").select("k1", "k2")
    # Pass 3. A start is told by what it has before and after the common part.
    starts = same.join(mixed, ["k1", "k2"], "left_semi").withColumn("t", F.explode(F.sequence("near", "far")))
    starts = starts.select(
        "k1", "k2", "t", "n", "r",
        F.expr("substring(before, cast(length(before) - t + 1 as int), cast(t as int))").alias("b"),
        F.expr(f"substring(after, 1, cast({CELL - 1} - t as int))").alias("a"),
    )
    starts = cut(starts)
    start = ["k1", "k2", "t", "b", "a"]
    twice = starts.groupBy(*start).agg(F.sum("n").alias("s")).filter("s > 1").select(*start)
    alone = starts.filter("n = 1").join(twice, start, "left_semi").select("r.row", "r.row2", (F.col("r.base") - F.col("t")).alias("first"), (F.col("r.base") - F.col("t")).alias("last"))

    spans = whole.unionByName(in_cells).unionByName(alone)
    spans = cut(spans.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")))
    discard(runs, classes, cells, same, starts)

    def shown(text, edges):
        """What stays, from the edges of the kept runs."""
        runs = [text[a:b].tobytes() for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        return None if keep == "none" else b"".join(runs) if keep == "bytes" else "".join(r.decode("utf-8", "ignore") for r in runs)

    def remove(batches):
        for batch in lean(batches):
            data, offsets = byte_view(batch.column("text"))
            out: list[list] = [[], [], [], [], []]
            for i, s in enumerate(batch.column("spans")):
                text = data[offsets[i] : offsets[i + 1]]
                n_spans, gone = 0, 0
                kept, edges = text, np.array([0, len(text)])
                if s.is_valid:
                    edge = np.zeros(len(text) + 1, np.int32)
                    np.add.at(edge, s.values.field("first").to_numpy(), 1)
                    np.add.at(edge, np.minimum(s.values.field("last").to_numpy() + length, len(text)), -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    if min_words:
                        turns = np.flatnonzero(np.diff(covered, prepend=False, append=False))
                        for lo, hi in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
                            if len(text[lo:hi].tobytes().split()) < min_words:
                                covered[lo:hi] = False
                    gone = int(covered.sum())
                    n_spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                    kept, edges = text[~covered], np.flatnonzero(np.diff(~covered, prepend=False, append=False))
                raw = kept.tobytes()
                for c, v in zip(out, (len(text), gone, n_spans, hashlib.sha256(raw).hexdigest(), shown(text, edges)), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if keep == "text" else pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True)), *(batch.column(c) for c in held)], [f.name for f in schema])

    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept " + ("string" if keep == "text" else "binary"))
    results = {f.name for f in schema}
    schema = T.StructType([*schema.fields, *[T.StructField(h, docs.schema[c].dataType) for c, h in zip(carry, held, strict=True)]])
    cols = ["doc_id", "text", "spans", *held]
    touched, others = fetched(whole_rows, spans, ROW, rest=True)
    rows = touched.select(*cols)
    if others is not None:
        rows = rows.unionByName(others.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).select(*cols))
    return rows.mapInArrow(remove, schema).withColumnsRenamed({h: f"{c}_in" if c in results else c for c, h in zip(carry, held, strict=True)})
