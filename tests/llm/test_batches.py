import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import jaccard

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    before = spark.conf.get(LIMIT, None)
    spark.conf.unset(LIMIT)
    yield
    spark.conf.unset(LIMIT)
    if before is not None:
        spark.conf.set(LIMIT, before)


def largest(docs):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    return docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


def test_stages_send_small_batches_to_python(spark, unset):
    docs = spark.range(40, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100_000).alias("text"), F.lit(1).alias("n_chars"))
    corpus_pipeline.mask_secrets(spark, docs, "")
    assert largest(docs) < 5_000_000
    spark.conf.set(LIMIT, "8m")  # the session's own limit stays
    corpus_pipeline.pack_sequences(spark, docs, "")
    assert spark.conf.get(LIMIT) == "8m" and largest(docs) > 5_000_000


def test_repeats_need_one_copy_of_the_tokens():
    rnd = np.random.default_rng(3)
    for n, values in ((0, 1), (1, 1), (2, 1), (50, 10), (1000, 10**6)):
        parts = [rnd.integers(0, values, n).astype(np.uint64) for _ in range(3)]
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        found = jaccard.repeated(parts)
        assert not parts and found[0].tolist() == keys[counts > 1].tolist() and found[1].tolist() == counts[counts > 1].tolist()
    parts = [rnd.integers(0, 1 << 63, 1000).astype(np.uint64) for _ in range(1000)]
    tracemalloc.start()
    jaccard.repeated(parts)
    assert tracemalloc.get_traced_memory()[1] < 12_000_000  # the tokens are 8,000,000 bytes
    tracemalloc.stop()
