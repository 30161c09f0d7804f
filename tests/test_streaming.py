"""The stateless cleaners give the same rows on a stream as in batch."""

import json
import os

from spanlake.session import local_fs_path, scratch_path
from spanlake.streaming.clean_stream import QA_SCHEMA, cleaned_examples, start_clean_stream


def test_clean_stream_matches_batch(spark):
    src = scratch_path(spark, "stream-src")
    local = local_fs_path(src)
    os.makedirs(local, exist_ok=True)
    rows = [{"id": str(i), "question": f"q~{i}\n", "context": f"“ctx”  {i} # answer{i}",
             "answers": {"answer_start": [8], "text": [f"{i} # answer{i}"]}} for i in range(20)]
    with open(os.path.join(local, "part-0.json"), "w", encoding="utf-8") as f:
        for r in rows:
            f.write(json.dumps(r, ensure_ascii=False) + "\n")
    sink, ckpt = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    q = start_clean_stream(spark, src, sink, ckpt)
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    batch = cleaned_examples(spark.read.schema(QA_SCHEMA).json(src))
    assert got == sorted(tuple(r) for r in batch.collect())
    assert len(got) == 20
