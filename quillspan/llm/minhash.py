"""Near duplicates: inverted lists of signature coordinates give candidates, and full shingle sets decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.components import connected_components
from quillspan.llm.scratch import cut, short_batches

#: Coordinates of a signature.
COORDINATES = 64
#: At most so many coordinate values are called frequent: those that every 1 / FREQUENT of all postings or more hold.
FREQUENT = 100_000
#: Postings of one value up to which its documents are compared pair by pair. Longer lists are compared with PIVOTS of their documents first.
SHORT_LIST, PIVOTS = 128, 4
#: Documents and shingles of one block of a large group: what one task compares with another block.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 18
#: Stands for a root where a block holds documents of several roots.
SHARED = -(1 << 62)
#: Bytes of a table, by its rows and what one takes, up to which it is broadcast.
SMALL = 8 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def least_matches(percent: int, deviations: float = 5) -> int:
    """How many coordinates must agree. Each of a link's does with a chance of percent / 100 or more, so that fewer than five deviations below the mean do about once in a million links of that similarity, and fewer than eight below it less than once in 10 ** 14."""
    p = percent / 100
    return max(1, int(COORDINATES * p - deviations * (COORDINATES * p * (1 - p)) ** 0.5))


class WordHashes(dict):
    """64-bit hashes of words; emptied when it holds very many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_HASHES = WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of width words, with A-Z lower-cased; of all its words, if they are fewer; none without words."""
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mixed(out * _M1 + h[i : len(h) - n + 1 + i] * _M2)
    return np.unique(out)


def _permutations(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.Philox(key=[seed, 0]))
    return rng.integers(0, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, COORDINATES, np.uint64)


def signature(hashes: np.ndarray, permutations: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest value of each permutation of the hashes."""
    odd, shift = permutations
    out = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        x = (hashes[at : at + 1024, None] ^ shift) * odd
        out = np.minimum(out, (x ^ (x >> np.uint64(32))).min(0))
    return out


def _features(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    permutations = _permutations(seed)
    for batch in batches:
        n, prints, signs, folds = [], [], [], []
        for text in batch.column(1):
            h = shingle_hashes(text.as_py(), width)
            n.append(len(h))
            prints.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            sign = signature(h, permutations) if len(h) else None
            signs.append(sign.tobytes() if len(h) else None)
            folds.append(_mixed(sign).astype(np.uint8).tobytes() if len(h) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.binary()), pa.array(folds, pa.binary())], ["doc_id", "n_shingles", "print", "sign", "fold"])


def _values(signs: pa.Array) -> np.ndarray:
    """Each signature's coordinate-value pairs as 64-bit numbers."""
    sig = np.frombuffer(b"".join(signs.to_pylist()), np.uint64).reshape(-1, COORDINATES)
    return _mixed(sig * _M1 + np.arange(COORDINATES, dtype=np.uint64) * _M2).view(np.int64)


def _all_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_values(batch.column(0)).ravel())], ["value"])


def _postings(batches: Iterator[pa.RecordBatch], frequent, matches: int) -> Iterator[pa.RecordBatch]:
    """The prefix of each signature in the order of frequency, values that aren't frequent first: two signatures with enough equal coordinates share one value of that prefix."""
    prefix = COORDINATES - matches + 1
    known, often = frequent.value
    for batch in batches:
        values = _values(batch.column(2))
        at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
        count = np.where(known[at] == values, often[at], 0) if len(known) else np.zeros_like(values)
        first = np.take_along_axis(values, np.lexsort((values, count), axis=1)[:, :prefix], 1)
        doc, n = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), prefix) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(first.ravel()), pa.array(doc), pa.array(n)], ["value", "doc", "n"])


def spanning_links(docs: np.ndarray, left: np.ndarray, right: np.ndarray, part: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links between places left and right that join their parts as all links between them do. near(i, places) says which places are linked with i; it is asked only for places of other parts."""
    part, out = part.copy(), []
    for i in left.tolist():
        others = right[part[right] != part[i]]
        if len(others):
            hit = others[near(i, others)]
            parts, at = np.unique(part[hit], return_index=True)
            out += [(int(docs[i]), int(docs[j])) for j in hit[at]]
            if len(parts):
                part[np.isin(part, parts)] = part[i]
    return out


def _by_sets(sets: list[np.ndarray], right: np.ndarray, percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Decides on full sets, through lists of the right ones' members."""
    size = np.array([len(s) for s in sets], np.int64)
    members = np.concatenate([sets[j] for j in right]) if len(right) else np.zeros(0, np.uint64)
    owner = np.repeat(right, size[right])
    order = np.argsort(members, kind="stable")
    members, owner = members[order], owner[order]

    def near(i: int, places: np.ndarray) -> np.ndarray:
        a, length = np.searchsorted(members, sets[i], "left"), np.searchsorted(members, sets[i], "right")
        length -= a
        spans = np.repeat(a - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
        common = np.bincount(owner[spans], minlength=len(sets))[places]
        return 100 * common >= percent * (size[i] + size[places] - common)

    return near


def _by_folds(folds: np.ndarray, size: np.ndarray, percent: int, matches: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Decides whether enough coordinates agree and sizes allow a link."""

    def near(i: int, places: np.ndarray) -> np.ndarray:
        fits = (100 * size[places] >= percent * size[i]) & (100 * size[i] >= percent * size[places])
        return fits & ((folds[places] == folds[i]).sum(1) >= matches)

    return near


def linked_in_block(docs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the documents at the places left with those at the places right into as few components as all links between them do, given the parts they are joined in already."""
    return spanning_links(docs, left, right, np.arange(len(docs)) if part is None else part, _by_sets(sets, right, percent))


def _blocks(rows: Column, shingles: Column) -> Column:
    return F.least(rows, F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES)))


def _small(df: DataFrame, row_bytes: int = 40) -> DataFrame:
    """A stored table, for a broadcast if its rows of so many bytes are few."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL else df


def _crossings(rows: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """How to compare documents that are in one group, but not joined yet. rows, a stored table: grp, doc, n and root.

    A root with half a block of documents or more has blocks of its own; the other roots of a group share blocks. Gives
    the rows of groups with several roots with their block (own, which is the root or SHARED, and at), and the pairs of
    blocks of one group, all but those of one root. None if there is no such group.
    """
    roots = cut(rows.groupBy("grp", "root").agg(F.count("*").alias("r"), F.sum("n").alias("w")), "roots")
    large = (F.col("r") >= BLOCK_ROWS // 2) | (F.col("w") >= BLOCK_SHINGLES // 2)
    several = roots.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1").select("grp")
    pools = cut(roots.where(~large).groupBy("grp").agg(_blocks(F.sum("r"), F.sum("w")).alias("pool")).join(several, "grp", "right"), "pools")
    if pools.isEmpty():
        return None
    own = cut(roots.where(large).select("grp", "root", _blocks(F.col("r"), F.col("w")).alias("parts")), "own")
    placed = rows.join(_small(pools), "grp").join(_small(own), ["grp", "root"], "left")
    at = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("root"), F.col("pool")))
    placed = cut(placed.select("grp", "doc", "root", F.when(F.col("parts").isNotNull(), F.col("root")).otherwise(SHARED).alias("own"), at.alias("at")), "cells")
    x = placed.select("grp", F.col("own").alias("x_own"), F.col("at").alias("x_at")).distinct()
    y = x.select("grp", F.col("x_own").alias("y_own"), F.col("x_at").alias("y_at"))
    return placed, x.join(y, "grp").where(f"struct(x_own, x_at) <= struct(y_own, y_at) and (x_own <> y_own or x_own = {SHARED})")


def _compared(placed: DataFrame, pairs: DataFrame, decide) -> DataFrame:
    """Links (a, b) between the documents of each pair of blocks. placed has what decide needs; it gets the rows of a pair, the places of each side, and the parts."""
    key = ["grp", "x_own", "x_at", "y_own", "y_at"]
    pairs = cut(pairs, "pairs")
    sides = pairs.select(*key, F.col("x_own").alias("own"), F.col("x_at").alias("at"), F.lit(True).alias("first"))
    sides = sides.unionByName(pairs.where("x_own <> y_own or x_at <> y_at").select(*key, F.col("y_own").alias("own"), F.col("y_at").alias("at"), F.lit(False).alias("first")))

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows["first"].to_numpy()
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        _, part = np.unique(rows["root"].to_numpy(), return_inverse=True)
        return pd.DataFrame(decide(rows, left, right if len(right) else left, part), columns=["a", "b"], dtype="int64")

    return placed.join(sides, ["grp", "own", "at"]).drop("own", "at").groupBy(*key).applyInPandas(each, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, deviations: float = 5, seed: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct shingles of width words
    (A-Z lower-cased; ASCII white space between words; all words as one shingle if they are fewer). component_id is the
    smallest id reachable over links, kept says whether that is the row's own.

    Texts with one set become one class. Each class posts its signature's values under their coordinates, but only the
    prefix in the order of frequency that classes with enough equal coordinates must share, so that very frequent values
    are skipped. Pairs from short lists join families if their signatures agree often enough. A long list is compared
    with four of its classes, and then only classes that are not joined yet, block by block, by the same count of equal
    coordinates. In a family full sets decide: within blocks of some 512 documents that four of the family's documents
    are added to, and then between blocks, where documents that are joined already are passed over. So a family of
    near copies costs in proportion to its size; only documents that agree in as many coordinates, but aren't linked,
    are compared pair by pair, spread over pairs of blocks.

    A link of exactly the required similarity lacks enough equal coordinates about once in a million; with more
    deviations below the mean it is rarer, down to any chance, and there are more candidates.

    A null text, or one without words, is linked with nothing; neither is a row with null id, whose component is null
    and which is kept. Rows with one id count as one document. An empty table gives an empty table. Other columns are
    not read. percent should be 80 or more, as candidates are sure for sets as similar as that or more.
    """
    spark = documents.sparkSession
    short_batches(spark)
    matches = least_matches(percent, deviations)
    texts = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    features = cut(texts.mapInArrow(lambda it: _features(it, width, seed), "doc_id bigint, n_shingles bigint, print binary, sign binary, fold binary"), "features")
    classes = features.where("print is not null and doc_id is not null").groupBy("print").agg(F.min(F.struct("doc_id", "n_shingles", "sign", "fold")).alias("c"))
    classes = cut(classes.select("print", F.col("c.doc_id").alias("doc"), F.col("c.n_shingles").alias("n"), F.col("c.sign").alias("sign"), F.col("c.fold").alias("fold")), "classes")

    least = max(2, -(-classes.count() * COORDINATES // FREQUENT))
    found = classes.select("sign").mapInArrow(_all_values, "value bigint").groupBy("value").count().where(F.col("count") >= least).toPandas().sort_values("value")
    frequent = spark.sparkContext.broadcast((found["value"].to_numpy(np.int64), found["count"].to_numpy(np.int64)))
    posted = cut(classes.select("doc", "n", "sign").mapInArrow(lambda it: _postings(it, frequent, matches), "value bigint, doc bigint, n bigint"), "postings")
    hubs = [F.min(F.struct(F.xxhash64("doc", F.lit(k)), "doc"))["doc"].alias(f"p{k}") for k in range(PIVOTS)]
    lists = cut(posted.groupBy("value").agg(F.count("*").alias("m"), *hubs).where("m > 1"), "lists")
    short = cut(posted.join(lists.where(F.col("m") <= SHORT_LIST).select("value"), "value"), "short")
    fits = f"x.doc < y.doc and 100 * x.n >= {percent} * y.n and 100 * y.n >= {percent} * x.n"
    pairs = short.alias("x").join(short.alias("y"), F.expr(f"x.value = y.value and {fits}")).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()
    folds = classes.select("doc", "n", "fold")
    both = cut(pairs, "pairs").join(folds.select(F.col("doc").alias("a"), F.col("fold").alias("fold_a")), "a").join(folds.select(F.col("doc").alias("b"), F.col("fold").alias("fold_b")), "b")
    alike = both.mapInArrow(lambda it: _agreeing(it, matches), "a bigint, b bigint")

    def by_folds(rows: pd.DataFrame, left: np.ndarray, right: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
        return spanning_links(rows["doc"].to_numpy(), left, right, part, _by_folds(_as_folds(rows["fold"]), rows["n"].to_numpy(), percent, matches))

    long = cut(lists.where(F.col("m") > SHORT_LIST).drop("m"), "long")
    some_long = not long.isEmpty()
    if some_long:
        at_pivots = long.select("value", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("doc")).join(folds, "doc").groupBy("value").agg(F.collect_list(F.struct("doc", "n", "fold")).alias("pivots"))
        at_pivots = cut(at_pivots, "pivots")
        held = cut(posted.drop("n").join(_small(long.select("value")), "value").join(folds, "doc").select("value", "doc", "n", "fold"), "held")
        alike = alike.unionByName(held.join(_small(at_pivots, 100 * PIVOTS), "value").select("doc", "n", "fold", "pivots").mapInArrow(lambda it: _near_pivots(it, percent, matches), "a bigint, b bigint").distinct())
    families = cut(connected_components(alike), "alike")
    if some_long:
        families = _joined_over(families, held.select(F.col("value").alias("grp"), "doc", "n"), lambda placed: placed.join(folds, "doc"), by_folds)
    families = families.join(classes.select(F.col("doc").alias("node"), "n"), "node")
    families = cut(families.select(F.col("root").alias("grp"), F.col("node").alias("doc"), "n"), "families")

    def with_sets(placed: DataFrame) -> DataFrame:
        found = texts.join(_small(placed), texts["doc_id"] == placed["doc"]).select("doc_id", "text", *placed.columns)
        columns = [c for c in placed.columns if c != "doc"]
        kinds = ", ".join(f"{c} {dict(placed.dtypes)[c]}" for c in columns)
        # rows of one id are alike here, and one of them is enough
        return found.drop("doc").mapInArrow(lambda it: _sets(it, width), f"doc bigint, hashes binary, {kinds}")

    def by_sets(rows: pd.DataFrame, left: np.ndarray, right: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
        return linked_in_block(rows["doc"].to_numpy(), [np.frombuffer(x, np.uint64) for x in rows["hashes"]], left, right, percent, part)

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby(["grp", "block"], sort=False):
            all_of = np.arange(len(part))
            out += by_sets(part, all_of, all_of, all_of)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    sizes = cut(families.groupBy("grp").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"), *hubs), "sizes")
    pivot = F.array_contains(F.array(*[f"p{k}" for k in range(PIVOTS)]), F.col("doc"))
    placed = families.join(_small(sizes, 80), "grp").select("doc", "grp", "blocks", pivot.alias("pivot"))
    sets = with_sets(cut(placed, "placed"))
    dealt = F.when(F.col("pivot"), F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), F.col("blocks"))))
    # small families are dealt together, about as much at a time as a block has, as each group costs milliseconds of its own
    all_rows, all_shingles = families.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bundles = max(1, all_rows // BLOCK_ROWS, all_shingles // BLOCK_SHINGLES)
    task = F.when(F.col("blocks") > 1, F.xxhash64("grp", "block")).otherwise(F.pmod(F.xxhash64("grp"), F.lit(bundles)))
    inside = sets.withColumn("block", F.explode(dealt)).withColumn("task", task).drop("pivot", "blocks").groupBy("task").applyInPandas(within, "a bigint, b bigint")
    roots = cut(connected_components(inside), "inside")
    split = sizes.where("blocks > 1").select("grp")
    if not split.isEmpty():
        roots = _joined_over(roots, families.join(_small(cut(split, "split")), "grp"), with_sets, by_sets)
    named = cut(classes.select("print", "doc").join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("print", F.coalesce("root", "doc").alias("root")), "named")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    out = features.select("doc_id", "n_shingles", "print").join(named, "print", "left").withColumn("component_id", own)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _agreeing(batches: Iterator[pa.RecordBatch], matches: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # 8 bits of each value, which others share now and then; full sets are compared later
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COORDINATES) for i in (2, 3))
        alike = pa.array((x == y).sum(1) >= matches)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(alike), batch.column(1).filter(alike)], ["a", "b"])


def _as_folds(folds) -> np.ndarray:
    return np.frombuffer(b"".join(folds), np.uint8).reshape(-1, COORDINATES)


def _near_pivots(batches: Iterator[pa.RecordBatch], percent: int, matches: int) -> Iterator[pa.RecordBatch]:
    """A link with each pivot of its list that a class is alike to."""
    for batch in batches:
        size, folds = batch.column(1).to_numpy(), _as_folds(batch.column(2).to_pylist())
        lists = batch.column(3)
        flat, count = lists.flatten(), lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(batch)), count)
        doc, n, fold = flat.field("doc").to_numpy(), flat.field("n").to_numpy(), _as_folds(flat.field("fold").to_pylist())
        fits = (100 * n >= percent * size[row]) & (100 * size[row] >= percent * n)
        own = batch.column(0).to_numpy()[row]
        hit = np.flatnonzero(fits & (own != doc) & ((folds[row] == fold).sum(1) >= matches))
        yield pa.RecordBatch.from_arrays([pa.array(doc[hit], pa.int64()), pa.array(own[hit], pa.int64())], ["a", "b"])


def _joined_over(roots: DataFrame, rows: DataFrame, with_payload: Callable[[DataFrame], DataFrame], decide) -> DataFrame:
    """roots (node, root), after the documents of each group of rows (grp, doc, n) that aren't joined yet have been compared too."""
    named = rows.join(roots, rows["doc"] == roots["node"], "left").select("grp", "doc", "n", F.coalesce("root", "doc").alias("root"))
    crossing = _crossings(cut(named, "named"))
    if crossing is None:
        return roots
    links = cut(_compared(with_payload(crossing[0]), crossing[1], decide), "crossing")
    name = roots.select(F.col("node").alias("doc"), "root")
    for side in "ab":
        links = links.join(name.withColumnRenamed("doc", side), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    again = cut(connected_components(links), "again").withColumnRenamed("root", "final")
    met = roots.join(again.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("final", "root").alias("root"))
    lone = again.join(roots.select("node"), "node", "left_anti").select("node", F.col("final").alias("root"))
    return met.unionByName(lone)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_hashes(t.as_py(), width).tobytes() for t in batch.column(1)], pa.binary()), *batch.columns[2:]], ["doc", "hashes", *batch.schema.names[2:]])


#: The links of three-word shingles and 85 %, by comparing all documents that share a shingle.
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT ways.b, r.root FROM r JOIN ways ON ways.a = r.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM n JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1) USING (doc_id)"""
