"""Intervals, islands, alignment of blocks and groups of drawing records, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(spans: DataFrame, by: str, start: str = "s", stop: str = "e", slack: int = 1) -> DataFrame:
    """Unions of spans of one group that overlap or lie within slack of each other."""
    order = Window.partitionBy(by).orderBy(start, stop)
    reach = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach + slack >= F.col(start), 0).otherwise(1))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(by, "_island").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("_island")


def gaps(merged: DataFrame, by: str, start: str = "s", stop: str = "e") -> DataFrame:
    """What lies between merged spans of a group."""
    after = F.lead(start).over(Window.partitionBy(by).orderBy(start))
    return merged.withColumn("_next", after).where(F.col("_next") > F.col(stop)).select(by, F.col(stop).alias("gap_start"), F.col("_next").alias("gap_stop"))


def match_equal(left: DataFrame, right: DataFrame, pair: str, text: str = "text", pos: str = "pos") -> DataFrame:
    """One-to-one matches of equal texts of a pair, first with first: an equi-join on the text and its running number."""
    nth = F.row_number().over(Window.partitionBy(pair, text).orderBy(pos))
    a = left.withColumn("nth", nth).select(pair, text, "nth", F.col(pos).alias("oi"))
    b = right.withColumn("nth", nth).select(pair, text, "nth", F.col(pos).alias("rj"))
    return a.join(b, [pair, text, "nth"]).select(pair, "oi", "rj")


def first_per_line(lines: DataFrame, by: str, line: str = "line", pos: str = "pos") -> DataFrame:
    """Each distinct line of a group at its first place."""
    return lines.groupBy(by, line).agg(F.min(pos).alias(pos))


def entity_numbers(pairs: DataFrame, by: str, pos: str = "pos", code: str = "code") -> DataFrame:
    """The number of the record that a pair belongs to: how many pairs with code 0 there were so far."""
    return pairs.withColumn("entity", F.sum(F.when(F.col(code) == "0", 1).otherwise(0)).over(Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def expand_blocks(spark, inserts: DataFrame, texts: DataFrame, most_depth: int = 6) -> DataFrame:
    """Each text of a block as often as the block is inserted, directly or through other blocks, down to most_depth."""
    return spark.sql(
        f"""
        WITH RECURSIVE reach(root, block, depth) AS (
          SELECT parent, child, 1 FROM {{inserts}} WHERE parent LIKE 'root%'
          UNION ALL
          SELECT r.root, i.child, r.depth + 1 FROM reach r JOIN {{inserts}} i ON i.parent = r.block WHERE r.depth < {most_depth})
        SELECT root, text, count(*) AS n FROM reach JOIN {{texts}} t ON t.block = reach.block GROUP BY root, text""",
        inserts=inserts,
        texts=texts,
    )


#: Parts into which rows are dealt to number them.
PARTS = 64


def numbered(df: DataFrame, key: Column, name: str) -> DataFrame:
    """df with the place of each row, from 1, in the order of a key of distinct whole numbers.

    Some quantiles of the key deal the rows into parts of about equal size; only these and the parts' sizes reach the
    driver, and rows are ordered within parts.
    """
    keyed = df.withColumn("_key", key)
    bounds = keyed.agg(F.percentile_approx("_key", [k / PARTS for k in range(1, PARTS)], 1000)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(b).cast("bigint") for b in bounds]).cast("array<bigint>"), lambda b: b < F.col("_key")))
    dealt = keyed.withColumn("_part", part)
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    before = F.array(*[F.lit(sum(sizes.get(q, 0) for q in range(k))).cast("bigint") for k in range(len(bounds) + 1)])
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_key")) + F.element_at(before, F.col("_part") + 1)
    return dealt.withColumn(name, place).drop("_key", "_part")


def held_rectangles(rects: DataFrame, inside: str, reach: float = 5) -> DataFrame:
    """file and id of the rectangles a (file, id, x0, y0, x1, y1, area) for which a larger one b of their file, of equal ones an earlier, stands in a relation that puts a inside b with reach to spare.

    Each b lies in at most three cells of a grid about as wide as b; each a is looked for in the cell of its left side,
    in the grids of its file. So no more pairs meet than lie side by side at one scale.
    """
    level = lambda r: F.ceil(F.log2(F.col(f"{r}.x1") - F.col(f"{r}.x0") + 2 * reach))
    cell = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("level")))
    large = rects.alias("b").withColumn("level", level("b")).withColumn("cell", F.explode(F.sequence(cell(F.col("x0") - reach), cell(F.col("x1") + reach))))
    levels = large.groupBy("file").agg(F.collect_set("level").alias("levels"))
    small = rects.join(levels, "file").withColumn("level", F.explode("levels")).drop("levels").withColumn("cell", cell(F.col("x0")))
    met = small.alias("a").join(large.alias("b"), F.expr(f"a.file = b.file AND a.level = b.level AND a.cell = b.cell AND (b.area > a.area OR (b.area = a.area AND b.id < a.id)) AND {inside}"), "left_semi")
    return met.select("file", "id").distinct()


#: About how many owners of equal sets stand in one row.
BLOCK = 512


def similar_sets(pieces: DataFrame, owner: str, piece: str, percent: int) -> DataFrame:
    """Pairs a < b of owners of distinct pieces with 100 * intersection >= percent * union, and their sizes na and nb.

    Sets are compared once, however many owners have them. Similar ones share a piece among the first few of either in
    the order of frequency; only such sets are compared. Pairs of sets then become those of their owners, in blocks dealt
    out over all tasks, so no task holds more than two blocks of owners.
    """
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rare = pieces.groupBy(piece).agg(F.count("*").alias("_often"))
    held = F.sort_array(F.collect_list(F.struct("_often", piece)))
    owned = pieces.join(rare, piece).groupBy(owner).agg(held.alias("_held")).select(F.col(owner).alias("_owner"), F.col("_held")[piece].alias("_set"))
    sets = owned.groupBy("_set").agg(F.min("_owner").alias("_first"), F.count("*").alias("_many")).withColumn("_n", F.size("_set"))
    first = F.slice("_set", F.lit(1), F.col("_n") - F.ceil(percent * F.col("_n") / 100).cast("int") + 1)
    keyed = sets.select("_first", "_n", F.explode(first).alias("_key"))
    x, y = (keyed.select(F.col("_first").alias(c), F.col("_n").alias(f"n{c}"), "_key") for c in "ab")
    near = x.join(y, "_key").where(f"a < b and 100 * na >= {percent} * nb and 100 * nb >= {percent} * na").select("a", "b", "na", "nb").distinct().repartition(tasks, "a", "b")
    of = lambda c: sets.select(F.col("_first").alias(c), F.col("_set").alias(f"_{c}"))
    common = F.size(F.array_intersect("_a", "_b"))
    linked = near.join(of("a"), "a").join(of("b"), "b").where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b", "na", "nb")
    linked = linked.unionByName(sets.where("_many > 1").select(F.col("_first").alias("a"), F.col("_first").alias("b"), F.col("_n").alias("na"), F.col("_n").alias("nb")))
    block = F.pmod(F.xxhash64("_owner"), F.ceil(F.col("_many") / BLOCK)).alias("_block")
    blocks = owned.join(sets, "_set").groupBy("_first", block).agg(F.collect_list("_owner").alias("_owners"))
    side = lambda c: blocks.select(F.col("_first").alias(c), F.col("_block").alias(f"_block{c}"), F.col("_owners").alias(f"_{c}"))
    dealt = linked.join(side("a"), "a").join(side("b"), "b").where("a < b or _blocka <= _blockb").repartition(tasks, "a", "b", "_blocka", "_blockb")
    pairs = dealt.withColumn("_x", F.explode("_a")).withColumn("_y", F.explode("_b")).where("a < b or _blocka < _blockb or _x < _y")
    up = F.col("_x") < F.col("_y")
    turned = lambda p, q, name: F.when(up, F.col(p)).otherwise(F.col(q)).alias(name)
    return pairs.select(turned("_x", "_y", "a"), turned("_y", "_x", "b"), turned("na", "nb", "na"), turned("nb", "na", "nb"))
