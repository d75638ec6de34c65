"""Exact Jaccard join over word shingles by a token-group matrix.

A document's set is split by hash range into parts; the parts (with their contents) are its tokens here. How many parts
there are follows from its size so that two documents at the threshold differ in fewer elements than there are parts: by
the pigeonhole principle they then have a known number of whole parts in common. Documents of equal sets are one row from
the start, and a token of one set alone says nothing.

Sets are partitioned into groups of bounded size, by the most frequent token of each, so that similar ones are together. The
matrix holds each group's token union, a row for each (token, group). A query's overlap with a group is bounded by the tokens
that it shares with the union; a group that shares too few for any member to link stays closed. The others are opened: an
inverted index of the group's elements gives the query's exact overlap with every member at once. Of the links found, those
that join parts of the graph that a task hasn't joined yet are kept, so neither pairs nor links of a large family of near
copies are ever listed, and none that matters is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, byte_view, cut, lean, mix, slices, small
from .graph import components
from .words import shingle_sets

#: Sets of a group, about, and queries that one task opens a group for.
GROUP_SETS, OPEN_QUERIES = 2048, 4096
#: Elements of an inverted index that are looked at together.
AT_ONCE = 1 << 21


class Parts:
    """The tokens of a set, for linking at num / den."""

    def __init__(self, num: int, den: int, most: int = 1 << 40):
        lo, self.lo, self.parts, self.differ = 1, [], [], []
        while lo <= most:
            hi = max(lo, int(lo * max(1.6, den / num)))
            d = hi * (den - num) // num
            self.lo.append(lo)
            self.differ.append(d)
            self.parts.append(d + 1 + max(2, d // 8) if d else 0)
            lo = hi + 1
        self.num, self.den = num, den
        self.bounds: dict[int, np.ndarray] = {}

    def _bounds(self, m: int) -> np.ndarray:
        if m not in self.bounds:
            self.bounds[m] = np.array([(j << 64) // m for j in range(1, m)], np.uint64)
        return self.bounds[m]

    def keys(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of s (sorted hashes), and with each how many of its level any set that links there shares at least.

        Level c serves pairs whose smaller set has a size of class c; the other is of it or the next class.
        """
        n = len(s)
        c = int(np.searchsorted(self.lo, n, "right")) - 1
        out, needs = [], []
        for level in (c, c - 1):
            if level < 0 or not self.parts[level] or (level < c and (self.lo[c] - 1) * self.den < self.num * n):
                continue
            # The smaller of two linked sets is no larger than s, and of this level's class at most.
            m, differ = self.parts[level], min(self.differ[level], n * (self.den - self.num) // self.num)
            cuts = np.concatenate([[0], np.searchsorted(s, self._bounds(m)), [n]])
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(s), dtype=np.uint64)])
            count = np.diff(cuts)
            j = np.arange(m, dtype=np.uint64)
            key = mix((sums[cuts[1:]] - sums[cuts[:-1]]) + mix((np.uint64(level) << np.uint64(40)) + j + (count.astype(np.uint64) << np.uint64(48))))
            # Equal parts may all be empty ones only if there are as many of those as parts that must be equal.
            empty = int((count == 0).sum())
            out.append(key if empty >= m - differ else key[count > 0])
            needs.append(np.full(len(out[-1]), min(max(1, m - differ - empty), 30_000), np.int16))
        return (np.concatenate(out), np.concatenate(needs)) if out else (np.empty(0, np.uint64), np.empty(0, np.int16))


def _name(s: np.ndarray) -> int:
    """A set's 64-bit name."""
    return int(mix((mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64) + np.uint64(len(s)))[None])[0].view(np.int64))


def _sets(batches, k: int):
    for batch in lean(batches):
        for part in slices(batch, "text"):
            yield part, shingle_sets(*byte_view(part.column("text")), k)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """id, n_shingles and component_id (least id reachable by links) for each row of docs.

    Two rows link when den * intersection >= num * union of their sets of k-word shingles (num at least half of den). Null,
    empty and wordless texts have no shingles and their own id. Rows with equal ids or texts stay rows of their own. Null ids
    stay null and count as larger than any other. Sets are compared by 64-bit hashes of their shingles.
    """
    import pyarrow as pa

    if not 2 * num >= den >= num > 0:
        raise ValueError("the threshold lies between a half and one")
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def digests(batches):
        for part, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_name(s) if len(s) else None for s in sets], pa.int64())],
                ["doc_id", "n_shingles", "set_id"],
            )

    def tokens(batches):
        parts, seen = Parts(num, den), set()
        for _, sets in _sets(batches, k):
            names, keys, needs = [], [], []
            for s in sets:
                if len(s) and (name := _name(s)) not in seen:
                    seen.add(name)
                    key, need = parts.keys(s)
                    keys.append(key)
                    names.append(np.full(len(key), name, np.int64))
                    needs.append(need)
            if len(seen) > 1 << 18:
                seen.clear()
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([y.view(np.int64) for y in keys], names, needs)], ["token", "set_id", "need"])

    digest = cut(base.mapInArrow(digests, "doc_id long, n_shingles long, set_id long"))
    whole = Window.partitionBy("token")
    matrix = base.mapInArrow(tokens, "token long, set_id long, need short")
    matrix = matrix.withColumn("lo", F.min("set_id").over(whole)).withColumn("hi", F.max("set_id").over(whole)).withColumn("n", F.count("*").over(whole)).filter("lo < hi")
    matrix = cut(matrix.select("token", "set_id", "need", "n").distinct())

    # Groups: the sets of one most frequent token, in blocks.
    home = cut(matrix.groupBy("set_id").agg(F.max(F.struct("n", "token"))["token"].alias("home")))
    crowd = home.groupBy("home").agg(F.ceil(F.count("*") / GROUP_SETS).alias("blocks"))
    home = cut(home.join(crowd, "home").select("set_id", F.xxhash64("home", F.pmod(F.xxhash64("set_id"), F.col("blocks"))).alias("grp")))
    home = cut(home.join(small(home.groupBy("grp").agg(F.count("*").alias("size")), 32), "grp"))
    rows = cut(matrix.select("token", "set_id", "need").join(home, "set_id"))
    union = rows.select("token", F.col("grp").alias("of"), F.col("size").alias("of_size")).distinct()
    # Of two groups, the smaller asks the larger, so that the fringe of a family asks its core; each asks itself, its members being there.
    shared = rows.join(union, "token").filter((F.col("size") < F.col("of_size")) | ((F.col("size") == F.col("of_size")) & (F.col("grp") > F.col("of")))).groupBy("set_id", "of", "need").agg(F.count("*").alias("n"))
    asks = cut(shared.filter("n >= need").select("set_id", F.col("of").alias("grp")).distinct())
    load = home.groupBy("grp").agg(F.count("*").alias("members"), F.lit(0).cast("long").alias("asks"))
    load = load.unionByName(asks.groupBy("grp").agg(F.lit(0).cast("long").alias("members"), F.count("*").alias("asks")))
    load = load.groupBy("grp").agg(F.sum("members").alias("members"), F.sum("asks").alias("asks")).filter("members + asks > 1")
    load = cut(load.select("grp", F.greatest(F.lit(1), F.ceil(F.col("asks") / OPEN_QUERIES)).cast("long").alias("chunks")))
    asked = asks.join(load, "grp").select("set_id", "grp", F.pmod(F.xxhash64("set_id"), F.col("chunks")).alias("chunk"), F.lit(2).alias("role"))
    # Members go to every chunk, and ask the others in the first.
    inside = home.drop("size").join(load, "grp").select("set_id", "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    work = cut(inside.withColumn("role", F.when(F.col("chunk") == 0, 0).otherwise(1)).unionByName(asked))

    wanted = digest.join(work.select("set_id").distinct(), "set_id").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    # Null for a set that only rows without an id hold.
    wanted = cut(wanted)

    def contents(batches):
        seen: set[int] = set()
        for _, sets in _sets(batches, k):
            # Rows of one id and text are sent once by a task; a set that several tasks send is a member twice, which changes nothing.
            new = {name: s for s in sets if len(s) and (name := _name(s)) not in seen}
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array([s.tobytes() for s in new.values()], pa.binary())], ["set_id", "elements"])

    ids = small(wanted.select(F.col("doc_id").alias("holder")).distinct(), 16)
    text = base.join(ids, base["doc_id"].eqNullSafe(ids["holder"]), "left_semi").mapInArrow(contents, "set_id long, elements binary")
    elements = cut(text.join(small(wanted.select("set_id"), 16), "set_id", "left_semi"))

    def opened(batches):
        group, links = None, _Links()
        for batch in lean(batches):
            at = list(zip(batch.column("grp").to_pylist(), batch.column("chunk").to_pylist(), strict=True))
            roles, names, blobs = batch.column("role").to_pylist(), batch.column("set_id").to_pylist(), batch.column("elements")
            for i, key in enumerate(at):
                if group is None or group.key != key:
                    if group is not None:
                        group.settle(links)
                    group = _Group(key, num, den)
                s = np.frombuffer(blobs[i].as_buffer(), np.uint64)
                if roles[i] < 2:
                    group.add(names[i], s.copy(), roles[i] == 0)
                else:
                    group.settle(links)
                    for other in group.linked(s):
                        links.join(names[i], other)
            if len(links.new) > 10_000:
                yield links.batch()
        if group is not None:
            group.settle(links)
        if links.new:
            yield links.batch()

    dealt = elements.join(small(work, 48), "set_id").repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "role", "set_id")
    found = cut(dealt.mapInArrow(opened, "a long, b long"))
    digest = digest.join(components(found).withColumnRenamed("vertex", "set_id"), "set_id", "left")
    digest = digest.withColumn("root", F.coalesce("root", "set_id"))
    least = digest.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return digest.join(least, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


class _Group:
    """The members of an opened group, and an inverted index of their elements once there are queries enough."""

    def __init__(self, key, num: int, den: int):
        self.key, self.num, self.den = key, num, den
        self.names: list[int] = []
        self.sets: list[np.ndarray] = []
        self.index = None
        self.settled = True

    def add(self, name: int, s: np.ndarray, asks: bool = False) -> None:
        self.names.append(name)
        self.sets.append(s)
        self.settled = self.settled and not asks

    def settle(self, links) -> None:
        """The links of members among each other, once they are all here."""
        if not self.settled:
            self.settled = True
            for name, s in zip(self.names, self.sets, strict=True):
                for other in self.linked(s) if len(self.sets) > 1 else ():
                    links.join(name, other)

    def linked(self, s: np.ndarray) -> list[int]:
        """The members that link to s."""
        if len(self.sets) <= 4:
            both = []
            for x in self.sets:
                i = np.searchsorted(x, s)
                both.append(int((x[np.minimum(i, len(x) - 1)] == s).sum()))
            both, sizes = np.array(both), np.array([len(x) for x in self.sets])
        else:
            if self.index is None:
                sizes = np.array([len(x) for x in self.sets])
                joined = np.concatenate(self.sets)
                order = np.argsort(joined, kind="stable")
                self.index = (joined[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes)
            joined, owners, sizes = self.index
            lo, hi = np.searchsorted(joined, s, "left"), np.searchsorted(joined, s, "right")
            both = np.zeros(len(sizes), np.int64)
            many = hi - lo
            ends = np.cumsum(many)
            cuts = [0, *np.searchsorted(ends, np.arange(AT_ONCE, int(ends[-1]) + AT_ONCE, AT_ONCE)).tolist(), len(s)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                n = many[a:b]
                if n.sum():
                    both += np.bincount(owners[np.arange(n.sum()) + np.repeat(lo[a:b] - np.cumsum(n) + n, n)], minlength=len(sizes))
        hit = np.flatnonzero(self.den * both >= self.num * (len(s) + sizes - both))
        return [self.names[i] for i in hit.tolist()]


class _Links:
    """Links of a task; one that joins what others have joined is left out."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.new: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self._root(a), self._root(b)
        if x != y:
            self.up[x] = y
            self.new.append((a, b))

    def batch(self):
        import pyarrow as pa

        out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*self.new, strict=True)], ["a", "b"])
        self.new = []
        if len(self.up) > 1 << 20:
            self.up.clear()
        return out
