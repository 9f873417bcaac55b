"""Sources mixed to target weights: whole copies for certain, the rest by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.scratch import cut

WORDS = r"[^\x20\x09-\x0D]+"
#: A document's weight falls with the logarithm of its length: 2 ** 20 / sqrt(1 + floor(log2(size))), as whole numbers so that sums are exact in any order.
LENGTH_WEIGHTS = [round(2**20 / (1 + b) ** 0.5) for b in range(63)]


def source_key(column: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), column.cast("string")), F.lit("n"))


def _binary_length(size: Column) -> Column:
    return (F.length(F.bin(F.greatest(size, F.lit(1)))) - 1).cast("int")


def _weight(stratum: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w).cast("bigint") for w in LENGTH_WEIGHTS]), stratum + 1)


def draw(doc_id: Column, seed: int) -> Column:
    """A number above 0 and below 1 for each id, the same in every run."""
    digits = F.substring(F.md5(F.concat(doc_id.cast("string"), F.lit(f":{seed}"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(2**48))


def _drawn(sized: DataFrame, seed: int, most: int) -> DataFrame:
    """sized (with its source's figures) and its whole copies, its chance of one more, its Pareto rank and that rank's bin."""
    expected = F.least(F.lit(float(most)), F.col("_scale") * _weight(_binary_length(F.col("_size"))).cast("double"))
    out = sized.withColumn("_expected", expected).withColumn("_whole", F.floor("_expected"))
    out = out.withColumn("_chance", F.col("_expected") - F.col("_whole")).withColumn("_u", draw(F.col("_id"), seed))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_chance") / (1 - F.col("_chance")))
    out = out.withColumn("_rank", F.when(F.col("_chance") > 0, odds))
    return out.withColumn("_bin", F.floor(F.col("_rank") / (1 + F.col("_rank")) * F.col("_bins")))


def mix_plan(sized: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """One row for each source of a stored table of _id, _key, _source and _size: its size, target, scale and the last rank that is taken.

    Targets: each source's share of all words by its weight, but no more than most times its own; what is over is shared
    again by weight. The scale makes the documents' expected copies, scale times the weight of their length and at most
    most, add up to the target in words. Documents take the whole part of that for certain; the fraction is their chance
    of one more. In the order of random odds divided by the odds of that chance they are taken as long as the words they
    have fit; where that ends is found by sums over bins of the ranks and then within one bin. One more document, of
    the size nearest to the words then left, is taken if that brings the sum nearer to the target.
    """
    strata = sized.groupBy("_key", _binary_length(F.col("_size")).alias("_b")).agg(F.sum("_size").alias("_words"), F.count("*").alias("_n"), F.min("_source").alias("_source"))
    strata = cut(strata, "strata")
    whole, ordered = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy
    sources = strata.groupBy("_key").agg(F.sum("_words").alias("_source_size"), F.sum("_n").alias("_n"), F.min("_source").alias("_source"))
    sources = sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(ordered(F.col("_source").asc_nulls_last())) - 1, F.lit(len(weights))).cast("int") + 1))
    by_ratio = ordered((F.col("_source_size").cast("double") / F.col("_weight")).asc(), F.col("_key").asc())
    below, from_here = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    sources = sources.withColumn("_level", (F.sum("_source_size").over(whole) - most * F.coalesce(F.sum("_source_size").over(below), F.lit(0))).cast("double") / F.sum("_weight").over(from_here))
    fits = F.col("_level") * F.col("_weight") <= most * F.col("_source_size")
    sources = sources.withColumn("_shared", F.min(F.when(fits, F.struct(F.col("_source_size").cast("double") / F.col("_weight"), F.col("_key"), F.col("_level")))).over(whole)["_level"])
    sources = sources.withColumn("_target", F.least((most * F.col("_source_size")).cast("double"), F.coalesce(F.col("_shared") * F.col("_weight"), (most * F.col("_source_size")).cast("double"))))
    sources = cut(sources.select("_key", "_source_size", "_target", F.ceil(F.sqrt(F.col("_n").cast("double"))).alias("_bins")), "sources")

    per = Window.partitionBy("_key")
    down = per.orderBy(F.col("_b"))
    lower, rest = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    scaled = strata.select("_key", "_b", "_words", _weight(F.col("_b")).alias("_w")).join(sources, "_key")
    scaled = scaled.withColumn("_left", F.sum(F.col("_words") * F.col("_w")).over(rest).cast("double"))
    scaled = scaled.withColumn("_c", F.when(F.col("_left") > 0, (F.col("_target") - (most * F.coalesce(F.sum("_words").over(lower), F.lit(0))).cast("double")) / F.col("_left")))
    scaled = scaled.withColumn("_scale", F.coalesce(F.min(F.when(F.col("_c") * F.col("_w") <= most, F.struct("_b", "_c"))).over(per)["_c"], F.lit(float(most))))
    certain = F.floor(F.least(F.lit(float(most)), F.col("_scale") * F.col("_w").cast("double"))) * F.col("_words")
    plan = scaled.groupBy("_key").agg(F.first("_source_size").alias("_source_size"), F.first("_target").alias("_target"), F.first("_bins").alias("_bins"), F.first("_scale").alias("_scale"), (F.first("_target") - F.sum(certain).cast("double")).alias("_over"))
    plan = cut(plan, "plan")

    ranked = _drawn(sized.select("_id", "_key", "_size").join(plan, "_key"), seed, most).where("_rank is not null")
    bins = cut(ranked.groupBy("_key", "_bin").agg(F.sum("_size").alias("_words"), F.first("_over").alias("_over")), "bins")
    bins = bins.withColumn("_before", F.coalesce(F.sum("_words").over(per.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = bins.where("_before <= _over").groupBy("_key").agg(F.max(F.struct("_bin", "_before")).alias("_at")).select("_key", F.col("_at._bin").alias("_last_bin"), F.col("_at._before").alias("_before"))
    last = cut(last, "last")
    inside = ranked.join(last, "_key").where("_bin = _last_bin")
    run = per.orderBy("_rank", "_id", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("_end", F.col("_before") + F.sum("_size").over(run)).where("_end <= _over")
    edge = inside.groupBy("_key").agg(F.max(F.struct("_rank", "_id", "_size")).alias("_edge"), F.max("_end").alias("_end"))
    plan = cut(plan.join(last, "_key", "left").join(edge, "_key", "left").withColumn("_left", F.col("_over") - F.coalesce("_end", "_before", F.lit(0))).drop("_before", "_end"), "edge")
    rest = _drawn(sized.select("_id", "_key", "_size").join(plan, "_key"), seed, most).where(F.col("_rank").isNotNull() & ~_in_order())
    nearest = rest.withColumn("_miss", F.abs(F.col("_size") - F.col("_left"))).where("_miss < _left").groupBy("_key").agg(F.min(F.struct("_miss", "_rank", "_id", "_size")).alias("_extra"))
    return cut(plan.join(nearest, "_key", "left"), "mix")


def _in_order() -> Column:
    """Whether a row comes before its source's words are used up."""
    return F.coalesce((F.col("_bin") < F.col("_last_bin")) | ((F.col("_bin") == F.col("_last_bin")) & (F.struct("_rank", "_id", "_size") <= F.col("_edge"))), F.lit(False))


def mix_columns(documents: DataFrame, plan: DataFrame, *, seed: int = 17, most: int = 3) -> DataFrame:
    """documents with _id, _key and _size, and their copies, by the plan. No shuffle of documents while the plan, a row for each source, is small enough to be broadcast."""
    out = _drawn(documents.join(plan, "_key"), seed, most)
    extra = (F.col("_rank") == F.col("_extra._rank")) & (F.col("_id") == F.col("_extra._id")) & (F.col("_size") == F.col("_extra._size"))
    return out.withColumn("_copies", F.col("_whole") + F.coalesce(_in_order() | extra, F.lit(False)).cast("bigint"))


def sized_rows(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1)).alias("_id"), source_key(F.col(source_col)).alias("_key"), F.col(source_col).cast("string").alias("_source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("bigint").alias("_size")]


def mix_sources(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """How much of each row a mix by sources takes: doc_id, size (words), source_size, target, copies and taken (words).

    Sources in code-point order, null last, weigh 1, 2, 3 and so on again. Short documents have somewhat larger chances
    than long ones. Draws depend on ids alone, so that reruns agree.

    A null text has size 0 and is taken for 0 words. A null id draws like -1. Rows with one id draw the same number; rows
    that are equal in id and size share the last place, all or none. An empty table gives an empty table. Other columns
    are not read. What is shuffled: sums for each source and power of two of lengths, sums over the square root of a
    source's rows of rank bins, and one such bin for each source. The targets rest on running sums over all sources, which
    one task makes from a row of some 100 bytes for each; ten million sources are a gigabyte there.
    """
    stored = cut(documents.select(F.col(id_col).alias("doc_id"), *sized_rows(documents, id_col, text_col, source_col)), "sized")
    out = mix_columns(stored, mix_plan(stored, weights=weights, most=most, seed=seed), seed=seed, most=most)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def repeat_by_mix(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """Rows of documents, each as often as the mix takes it."""
    columns = documents.columns
    keys = sized_rows(documents, id_col, text_col, source_col)
    plan = mix_plan(cut(documents.select(*keys), "sized"), weights=weights, most=most, seed=seed)
    named = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_document"), *keys)
    out = mix_columns(named, plan, seed=seed, most=most).where("_copies > 0")
    return out.select("_document", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_document.*")


def mix_sql(weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17) -> str:
    """The mix of documents as DuckDB's SQL, with each source's rows in one window."""
    return rf"""
WITH sized AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
strata0 AS (SELECT *, list_extract({LENGTH_WEIGHTS}, CAST(length(bin(greatest(size, 1))) AS INTEGER)) AS w, length(bin(greatest(size, 1))) - 1 AS b FROM sized),
sources AS (SELECT key, min(source) AS source, sum(size) AS ss FROM sized GROUP BY 1),
weighed AS (SELECT *, list_extract({list(weights)}, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1 AS INTEGER)) AS weight FROM sources),
levels AS (SELECT *, CAST(ss AS DOUBLE) / weight AS ratio, CAST(sum(ss) OVER () - {most} * coalesce(sum(ss) OVER (ORDER BY CAST(ss AS DOUBLE) / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / sum(weight) OVER (ORDER BY CAST(ss AS DOUBLE) / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
shared AS (SELECT arg_min(level, {{'r': ratio, 'k': key}}) FILTER (WHERE level * weight <= {most} * ss) AS shared FROM levels),
targets AS (SELECT key, ss, least(CAST({most} * ss AS DOUBLE), coalesce(shared * weight, CAST({most} * ss AS DOUBLE))) AS target FROM levels, shared),
strata AS (SELECT key, b, w, sum(size) AS words FROM strata0 GROUP BY ALL),
scaled AS (SELECT s.*, target, (target - CAST({most} * coalesce(sum(words) OVER (PARTITION BY key ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)) / nullif(CAST(sum(words * w) OVER (PARTITION BY key ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE), 0) AS c FROM strata s JOIN targets USING (key)),
scales AS (SELECT key, coalesce(arg_min(c, b) FILTER (WHERE c * w <= {most}), CAST({most} AS DOUBLE)) AS scale FROM scaled GROUP BY 1),
plan AS (SELECT key, any_value(scale) AS scale, any_value(target) - CAST(sum(floor(least(CAST({most} AS DOUBLE), scale * CAST(w AS DOUBLE))) * words) AS DOUBLE) AS over FROM scaled JOIN scales USING (key) GROUP BY 1),
expected AS (SELECT doc_id, key, size, over, least(CAST({most} AS DOUBLE), scale * CAST(w AS DOUBLE)) AS x, (CAST(CAST('0x' || substring(md5(doc_id || ':{seed}'), 1, 12) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / {float(2**48)}::DOUBLE AS u FROM strata0 JOIN plan USING (key)),
ranked AS (SELECT *, CAST(floor(x) AS BIGINT) AS whole, CASE WHEN x > floor(x) THEN (u / (1 - u)) / ((x - floor(x)) / (1 - (x - floor(x)))) END AS rank FROM expected),
summed AS (SELECT *, sum(size) OVER (PARTITION BY key ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS stop FROM ranked WHERE rank IS NOT NULL),
remaining AS (SELECT key, any_value(over) - coalesce(max(stop) FILTER (WHERE stop <= over), 0) AS rest FROM summed GROUP BY 1),
extra AS (SELECT key, min({{'m': abs(size - rest), 'r': rank, 'i': doc_id, 's': size}}) AS e FROM summed JOIN remaining USING (key) WHERE stop > over AND abs(size - rest) < rest GROUP BY 1)
SELECT r.doc_id, r.size, CAST(ss AS BIGINT) AS source_size, target, r.whole + CASE WHEN coalesce(stop <= r.over, false) OR coalesce(e.i = r.doc_id AND e.s = r.size AND e.r = r.rank, false) THEN 1 ELSE 0 END AS copies, copies * r.size AS taken
FROM ranked r JOIN targets USING (key) LEFT JOIN summed s ON s.doc_id = r.doc_id AND s.size = r.size LEFT JOIN extra ON extra.key = r.key"""
