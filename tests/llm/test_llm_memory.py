"""What keeps a Python worker's memory small."""

import numpy as np
import pyarrow as pa

from fluvia.llm import quality, simhash


def test_workers_take_batches_in_slices(spark, monkeypatch):
    """pipeline: vectors and copies of a batch's 10,000 texts were held at once, in each worker."""
    made = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: made.append(run) or spark.createDataFrame([], schema))
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = quality.Model(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), np.zeros(quality.WIDTH), 0.0, 1.0)
    quality.score(docs, model, keep=["doc_id"])
    simhash.sketches(docs, "doc_id", "text", 5)
    texts, ids, held = pa.array([f"text {i} of some words" for i in range(2500)]), pa.array(range(2500)), pa.array([False] * 2500)
    for run, columns in zip(made, ([texts, ids, held], [ids, pa.array([b"x"] * 2500), texts]), strict=True):
        batch = pa.RecordBatch.from_arrays(columns, names=["a", "b", "c"])
        assert [b.num_rows for b in run(iter([batch]))] == [1000, 1000, 500]
