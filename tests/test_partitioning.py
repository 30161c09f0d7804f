"""Results do not depend on the number of shuffle partitions (1 vs 16)."""

import pytest

import __spark_entry__ as entry_mod
from scripts.check_oracle import rows_canon

NAMES = ["bm25_topk", "bm25_multifield", "retrieved_context", "token_windows", "train_features",
         "batch_padding", "nbest_null", "nbest_probability", "ensemble_majority", "kfold_assign",
         "vocab_extend", "evaluate_all"]


@pytest.mark.parametrize("name", NAMES)
def test_same_result_1_and_16_partitions(spark, sf_small, name):
    q = entry_mod.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = q(spark, sf_small)
            out.append(rows_canon(df.columns, [tuple(r) for r in df.collect()]))
        assert out[0] == out[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
