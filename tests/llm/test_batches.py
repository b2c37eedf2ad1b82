"""What a task holds of long texts at once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridquarry.llm import common, jaccard, language, packing


@pytest.mark.parametrize("run", [language.keep_identified, jaccard.one_of_each, packing.pack_documents])
def test_long_texts_reach_python_in_small_batches(spark, run):
    """2,000 texts of 20,000 characters each, in one partition: Spark's own batches would be one of 40 MB."""
    own = spark.newSession()
    docs = own.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.rpad(F.concat(F.lit("text "), "id"), 20_000, " of words").alias("text"), F.lit("en").alias("lang"))
    run(docs.limit(20))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    found = docs.select("text").mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in found) == 2000 and max(r["bytes"] for r in found) < 1.5 * common.BATCH_BYTES
