"""Arrow batches of readers stay small, whatever the table's size."""

import pyarrow as pa
import pytest

from quillspan.operators.units import BATCH_BYTES
from quillspan.plans import catalog

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("name", ["a19_doc", "a13_docx", "o19_titles", "g10_row_runs", "o08_recovered"])
def test_batches_end_by_bytes(name, spark):
    before = spark.conf.get(SETTING)
    spark.conf.unset(SETTING)
    try:
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        held = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
        sizes = [r.n for r in spark.range(0, 2000, 1, 1).selectExpr("repeat('x', 5000) AS text").mapInArrow(held, "n bigint").collect()]
        assert max(sizes) <= 2 * BATCH_BYTES
    finally:
        spark.conf.set(SETTING, before)
