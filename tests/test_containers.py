"""Queries of containers on documents without a line."""

import duckdb
import pytest

from quillspan.plans import catalog


@pytest.mark.parametrize("name", ["a02_dispatch", "a15_first_sheet", "b04_nested_archives", "e03_workbook_sheets"])
def test_documents_without_lines(name, spark, tmp_path):
    texts = ["a line\nmore", "", None, " \n\t\n", "x y z"] * 6
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(path)
    want = duckdb.connect().execute(f"WITH documents AS (FROM '{path}/*.parquet') {catalog.SQL[name]}").df()
    got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
    rows = lambda df: sorted(map(str, df[sorted(want.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
