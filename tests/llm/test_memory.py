import ctypes

import pytest

from yearbook.llm.simhash import fingerprints
from yearbook.sources.shared import written


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="only glibc can be asked to give memory back")
def test_workers_give_memory_back(spark):
    def held(batches):
        """MB that this worker, of those that Spark has kept, still holds of what its tasks have freed."""
        import pyarrow as pa

        def mb():
            with open("/proc/self/smaps_rollup") as f:
                return next(int(x.split()[1]) for x in f if x.startswith("Rss:")) / 1024

        for _ in batches:
            pass
        before = mb()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        yield pa.record_batch({"mb": pa.array([before - mb()])})

    docs = spark.range(0, 4000, 1, 2).selectExpr("id AS doc_id", "repeat(concat(id, ' some more words '), 400) AS text")
    assert written(fingerprints(docs)).count() == 4000
    got = [x["mb"] for x in spark.range(0, 8, 1, 8).mapInArrow(held, "mb double").collect()]
    assert max(got) < 40, got
