"""Approximate nearest neighbours by counting collisions of single projections.

Every vector is projected on a few random lines, and each line keeps its projections sorted. A query is the centre of a
window on each line; the windows widen together, doubling as one would double the buckets of a hash (virtual rehashing).
A vector found in enough windows is verified with its exact score. Widening ends when enough were verified.
Rows are dealt to blocks by a hash of their id, queries to groups; each block is searched with each group in a task of its
own, and the best of all blocks are ranked. Largest inner product becomes least distance by one more coordinate, which
gives all rows of a block the same norm.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, GROUP_QUERIES = 8192, 2048


class CollisionIndex:
    """lines: random projections; share: of the lines in whose windows a vector must be; verify and least: share and number of the rows to verify at least.

    The defaults are for vectors with hardly any structure, whose nearest rows are not much nearer than the others.
    """

    def __init__(self, rows: np.ndarray, lines: int = 64, share: float = 0.7, verify: float = 0.25, least: int = 256, width: float = 0.9, seed: int = 5):
        self.rows, self.share, self.verify, self.least = rows, share, verify, least
        norm2 = (rows * rows).sum(axis=1)
        self.most = float(norm2.max())
        rest = np.sqrt(np.maximum(self.most - norm2, 0))
        self.axes = np.random.default_rng(seed).standard_normal((rows.shape[1] + 1, lines))
        at = rows @ self.axes[:-1] + rest[:, None] * self.axes[-1]
        self.order = np.argsort(at, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(at.T, self.order, 1)
        self.width = width * float(np.sqrt(2 * self.most))

    def search(self, queries: np.ndarray, k: int):
        """(place of the query, places of the rows to verify for it), k of them at least if there are so many."""
        lines, n = self.sorted.shape
        # A query's own norm doesn't rank rows; scaled to theirs it stands where its best rows are.
        scale = np.sqrt(self.most / np.maximum((queries * queries).sum(axis=1), 1e-300))
        centre = ((queries * scale[:, None]) @ self.axes[:-1]).T
        need, enough = min(n, max(k, self.least, int(self.verify * n))), int(np.ceil(self.share * lines))
        left = np.arange(len(queries))
        count = {}
        lo = hi = None
        half, flat, base = self.width, self.order.ravel(), np.arange(lines) * n
        while len(left):
            new_lo = np.stack([s.searchsorted(c - half, "left") for s, c in zip(self.sorted, centre[:, left], strict=True)], axis=1) + base
            new_hi = np.stack([s.searchsorted(c + half, "right") for s, c in zip(self.sorted, centre[:, left], strict=True)], axis=1) + base
            go = []
            for i, q in enumerate(left.tolist()):
                if lo is None:
                    rings = [(new_lo[i], new_hi[i])]
                else:
                    rings = [(new_lo[i], lo[i]), (hi[i], new_hi[i])]
                parts = [flat[a:b] for x, y in rings for a, b in zip(x.tolist(), y.tolist(), strict=True)]
                seen = np.bincount(np.concatenate(parts), minlength=n)
                seen = seen + count.pop(q) if q in count else seen
                found = np.flatnonzero(seen >= enough)
                if len(found) >= need:
                    yield q, found
                else:
                    count[q] = seen.astype(np.int16)
                    go.append(i)
            lo, hi, left = new_lo[go], new_hi[go], left[go]
            half *= 1.1


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (doubles) and dim of the vectors that take part: not null or zero, every component finite."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, queries: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each row that queries (SQL on vec_id) picks, its own id left out.

    The score is the inner product in double precision; ties go to the smaller id. Vectors that are null, zero or hold a null,
    NaN or infinity take no part; vectors of another length than a query's aren't its candidates. A query id that stands in
    several rows is answered once, for one of its equal vectors.
    """
    rows = usable(vectors, id_col, vector_col)
    total = rows.count()
    blocks = max(1, -(-total // BLOCK_ROWS))
    groups = max(1, -(-rows.filter(queries).count() // GROUP_QUERIES))
    dealt = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n))
    base = rows.withColumn("block", dealt(blocks, "block")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = rows.filter(queries).dropDuplicates(["vec_id"])
    asked = asked.withColumn("group", dealt(groups, "group").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(a, b):
        import pandas as pd

        out = {"query_id": [], "vec_id": [], "score": []}
        if len(a) and len(b):
            a = a.sort_values("vec_id")
            ids, x = a["vec_id"].to_numpy(), np.stack(a["v"].to_list())
            index = CollisionIndex(x)
            asked, points = b["vec_id"].tolist(), np.stack(b["v"].to_list())
            for i, at in index.search(points, k + 1):
                q, v = asked[i], points[i]
                at = at[ids[at] != q]
                # One row's products are summed alike wherever it stands, so equal vectors tie.
                score = (x[at] * v).sum(axis=1)
                best = np.lexsort((ids[at], -score))[:k]
                out["query_id"] += [q] * len(best)
                out["vec_id"] += ids[at][best].tolist()
                out["score"] += score[best].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = base.groupBy("block", "group", "dim").cogroup(asked.groupBy("block", "group", "dim")).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
