"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each source's target is its share of all words by weight, at most so many times its own size; what that leaves over goes to
the others by weight. A document's copies are target / size of its source; the whole part is taken as it is, and the
fraction is a probability. Fractions are rounded in pairs: of two, mass goes from one to the other at random until one is 0
or 1, and the other carries on, so the sum never changes and each keeps its expectation. Documents of like size meet first:
blocks of one source and size class are rounded each by itself, and the one fraction that a block is left with goes up a
tree of blocks, then over the size classes, to one of its source, which is drawn at last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

#: Documents of a block, about, and blocks that the next one combines.
BLOCK = 128
SPACE_RUNS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, most: float) -> DataFrame:
    """sizes: a row for each source, with size. Adds weight and target: the least of weight * level and most * size, level such that targets sum to all sizes."""
    # One small row a source; their order is a window over those alone.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    rows = rows.withColumn("cap", F.col("size") * most).withColumn("at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("at", F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("size").over(Window.partitionBy()) - full) / left)
    # Sources are filled up in order of cap / weight; the first that isn't gives the level.
    level = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "level"))).over(Window.partitionBy())["level"]
    return rows.withColumn("target", F.coalesce(F.least("cap", F.col("weight") * level), "cap")).select("source", "size", "weight", "target")


def _pivot(items: Column, salt: int) -> Column:
    """Rounds an array of structs (size, doc_id, p) in order. Gives the rounded ones with copies 0 or 1, and the one that is left, or null."""
    item = "struct<size:bigint,doc_id:bigint,p:double,n:bigint>"
    done_type = "array<struct<size:bigint,doc_id:bigint,copy:int,n:bigint>>"
    draw = lambda x, y: (F.xxhash64(F.lit(salt), x["doc_id"], y["doc_id"], x["n"], y["n"]).bitwiseAND(F.lit((1 << 53) - 1))).cast("double") / float(1 << 53)

    def step(s: Column, y: Column) -> Column:
        x = s["left"]
        total = x["p"] + y["p"]
        u = draw(x, y)
        # Below one in sum, one of the two becomes 0; else one becomes 1.
        first_ends = F.when(total < 1, u * total < y["p"]).otherwise(u * (2 - total) < 1 - y["p"])
        copy = (total >= 1).cast("int")
        rest = F.when(total < 1, total).otherwise(total - 1)
        ends = lambda z: F.struct(z["size"], z["doc_id"], copy.alias("copy"), z["n"])
        goes = lambda z: F.struct(z["size"], z["doc_id"], rest.alias("p"), z["n"])
        both = F.struct(F.concat(s["done"], F.array(F.when(first_ends, ends(x)).otherwise(ends(y)))).alias("done"), F.when(first_ends, goes(y)).otherwise(goes(x)).cast(item).alias("left"))
        return F.when(x.isNull(), F.struct(s["done"], y.cast(item).alias("left"))).otherwise(both)

    start = F.struct(F.array().cast(done_type).alias("done"), F.lit(None).cast(item).alias("left"))
    return F.aggregate(items, start, step)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = 3.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for each row of docs.

    A size is the text's number of words, 0 if null. Sources by code point, null last, weigh 1, 2, 3 and so on again. copies is
    at most most, rounded up. Draws hash ids and sizes, so reruns agree. Rows of one id that are alike in source and size are
    rounded as one with that many rows, and differ by a copy at most. carry: further columns that rows keep, under their own names.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(SPACE_RUNS)), F.lit(0)).cast("long").alias("size"),
        *[F.col(f"`{c}`") for c in carry],
    )
    rows = cut(rows)
    goals = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("size")), most)).withColumnRenamed("size", "source_size")
    key = rows["source"].eqNullSafe(goals["source"])
    rows = rows.join(small(goals, 64), key).select(rows["source"], "doc_id", "size", "source_size", "target", *[rows[c] for c in carry])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("base", F.floor(rate)).withColumn("p", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(F.lit(0.0)))
    # Rows alike in all that counts are rounded as one: their copies in sum, then dealt out by rank.
    alike = rows.filter("p > 0").groupBy("source", "doc_id", "size", "p").agg(F.count("*").alias("n"))
    alike = alike.withColumn("whole", F.floor(F.col("n") * F.col("p"))).withColumn("p", F.col("n") * F.col("p") - F.floor(F.col("n") * F.col("p")))
    alike = alike.withColumn("class", F.floor(F.log2("size") * 8)).drop("whole")
    counts = cut(alike.filter("p > 0").groupBy("source", "class").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    items = alike.filter("p > 0").alias("a").join(small(counts, 64).alias("c"), F.col("a.source").eqNullSafe(F.col("c.source")) & (F.col("a.class") == F.col("c.class")))
    items = items.select("a.source", "a.class", F.pmod(F.xxhash64(F.lit("block"), "doc_id", "size"), F.col("blocks")).alias("block"), F.struct("size", "doc_id", "p", "n").alias("item"))
    depth, widest = [], counts.agg(F.max("blocks")).head()[0] or 0
    while widest > 1:
        depth.append("block")
        widest = -(-widest // BLOCK)
    # Leaves, levels of blocks, then the size classes of a source, of which there are few: large sizes first, so that what
    # mass is left moves between like sizes and ends at a small document.
    done = []
    for level, step in enumerate(["leaf", *depth, "source"]):
        if step == "block":
            items = items.withColumn("block", F.expr(f"block div {BLOCK}"))
        elif step == "source":
            items = items.withColumn("block", F.lit(0).cast("long")).withColumn("class", F.lit(0).cast("long"))
        grouped = items.groupBy("source", "class", "block").agg(F.sort_array(F.collect_list("item"), False).alias("items"))
        state = cut(grouped.select("source", "class", "block", _pivot(F.col("items"), level).alias("r")))
        done.append(state.select("source", F.explode("r.done").alias("x")).select("source", "x.doc_id", "x.size", "x.n", F.col("x.copy").alias("extra")))
        items = state.filter("r.left is not null").select("source", "class", "block", F.col("r.left").alias("item"))
    # What a source is left with is drawn by its probability.
    u = F.xxhash64(F.lit("last"), "item.doc_id", "item.size").bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53)
    done.append(items.select("source", "item.doc_id", "item.size", "item.n", (u < F.col("item.p")).cast("int").alias("extra")))
    drawn = done[0]
    for x in done[1:]:
        drawn = drawn.unionByName(x)
    return _dealt(rows, cut(drawn), carry)


def _dealt(rows: DataFrame, drawn: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """rows with their copies. A row that stands alone takes its draw; of n alike, the whole copies in sum go to the first of them."""
    extra = drawn.select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("size").alias("z"), "n", "extra")
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z"))
    out = rows.join(extra, same, "left")
    many = Window.partitionBy("source", "doc_id", "size").orderBy("source", *carry)
    out = out.withColumn("n", F.coalesce("n", F.lit(1)))
    alone = F.coalesce("extra", F.lit(0))
    return (
        out.withColumn("rank", F.row_number().over(many))
        .withColumn("copies", (F.col("base") + F.when(F.col("p") > 0, (F.col("rank") <= F.floor(F.count("*").over(Window.partitionBy("source", "doc_id", "size")) * F.col("p")) + alone).cast("int")).otherwise(F.lit(0))).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)
    )
