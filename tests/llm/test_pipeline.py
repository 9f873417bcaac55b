"""The stages of the pipeline, each against the whole of what came before, and on odd tables."""

from collections import Counter

import pytest

import corpus_pipeline
from quillspan.llm import minhash, repetition, toxicity
from tests.llm.test_operators import brute_components, sets_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    (_, toxic), (_, quality), (_, dedup), (_, mixing), (_, packing) = corpus_pipeline.STAGES
    verdict = {r.doc_id: r.kept for r in toxicity.classify_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    one = corpus_pipeline.cut(toxic(spark, docs, SF), "t")
    assert {r.doc_id for r in one.collect()} == {i for i, k in verdict.items() if k}
    two = corpus_pipeline.cut(quality(spark, one, SF), "t")
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in repetition.repetition_rules(one).where("kept").collect()}
    three = corpus_pipeline.cut(dedup(spark, two, SF), "t")
    roots = brute_components(sets_of(two.collect(), 5), 80)
    assert {r.doc_id for r in three.collect()} == set(roots.values())
    four = corpus_pipeline.cut(mixing(spark, three, SF), "t")
    assert {r.doc_id for r in four.collect()} <= {r.doc_id for r in three.collect()}
    assert one.columns == two.columns == three.columns == four.columns == columns
    five = packing(spark, four, SF)
    assert five.where("piece = 0").count() == four.count()
    assert minhash.near_duplicates(three).where("not kept").count() == 0


FRESH = iter(range(10**9))


def prose(n):
    return " ".join(f"w{next(FRESH)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, no words, repeated rows, copies under null ids and one id, a long text, and columns named as stages name their own."""
    a, b, c, d = (prose(80) for _ in range(4))
    texts = [(None, a), (9, a), (3, a + " end"), (3, a), (4, b), (4, b), (4, c), (None, d), (None, d), (5, None), (6, ""), (7, " \n"), (8, prose(60_000)), (10, "few words"), (11, prose(60) + " one two three" * 60)]
    rows = [(i, t, "en", "s", 1, 2, 3, "x", 4, 5) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, row int, kept int, root int, document string, id int, n_words int")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(4, 1, 0), (9, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_on_odd_tables(spark, odd, folder):
    names = odd.columns
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    all_of = texts(odd)
    toxic = stages["toxicity"](spark, odd, folder)
    assert toxic.columns == names and not texts(toxic) - all_of
    good = stages["quality"](spark, odd, folder)
    left = texts(good)
    assert good.columns == names and left == Counter({k: v for k, v in all_of.items() if k[0] not in (5, 6, 7, 10, 11)})
    one = stages["near_dedup"](spark, odd, folder)
    by_id = {}
    for r in one.collect():
        by_id.setdefault(r.doc_id, []).append(r.text)
    assert one.columns == names and {k: len(v) for k, v in by_id.items()} == {3: 1, 4: 2, None: 1, 5: 1, 6: 1, 7: 1, 8: 1, 10: 1, 11: 1}
    mixed = stages["mixing"](spark, one, folder)
    assert mixed.columns == names and not set(texts(mixed)) - set(texts(one)) and max(texts(mixed).values()) <= 3
    packed = stages["packing"](spark, mixed, folder).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed.collect()) and all(r.length <= 4096 for r in packed)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), folder).count() == 0, name


def test_rows_are_judged_by_their_own_text(spark, folder):
    """A bad row takes no clean row of its id along, and one without id goes too."""
    good, bad = prose(100), "one two three four " * 40
    docs = spark.createDataFrame([(1, good), (1, bad), (None, bad), (None, prose(100))], "doc_id bigint, text string")
    kept = [(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["quality"](spark, docs, folder).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, good), (None, docs.collect()[3].text)]))


def test_run_on_odd_tables(spark, odd, folder):
    odd.write.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} <= {3, 4, 8, None} and any(r.doc_id == 8 for r in rows)
