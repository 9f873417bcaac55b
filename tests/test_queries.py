"""Each query of the library against its SQL, and the metric contract."""

import pytest

from quillspan.functions import text as T
from quillspan.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(name, same):
    same(catalog.QUERIES[name], catalog.SQL[name])


GOLDEN = [
    ("你好世界 Hello World 中文测试", 8, 2, 18),
    ("a,b c-d 12.5", 0, 3, 10),
    ("全角，，ＡＢ x", 6, 1, 7),
    ("안녕 하세요 ok", 5, 1, 7),
    ("かな abc", 0, 2, 5),
    ("\U00020000\U00020001 z", 0, 2, 3),
    ("a b", 0, 2, 2),
    ("a　b", 1, 2, 2),
    ("x\u001cy", 0, 2, 2),
    ("", 0, 0, 0),
]


def test_metric_contract(spark):
    rows = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, s string")
    got = rows.select("i", *T.metrics(rows["s"])).orderBy("i").collect()
    assert [(r.fe, r.nc, r.chars) for r in got] == [g[1:] for g in GOLDEN]
    assert all(r.words == r.fe + r.nc for r in got)


def test_real_han_reads_whole_texts(spark, tmp_path):
    texts = [(6, "é" * 60 + "aeioutrs" * 50), (12, "aeioutrs" * 8 + "é" * 100), (18, "aeioutrs" * 8)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["d10_real_han"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.real_cjk for r in got] == [True, False, True]
