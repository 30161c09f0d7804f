"""Slices of Arrow batches."""

import pyarrow as pa

from spanlake.operators import windows as Wn
from spanlake.operators import batches
from spanlake.operators.batches import SLICE_BYTES, sliced, slices


def test_slices_are_the_whole_array_in_order():
    texts = pa.array(["a" * 30, None, "b" * 200, "", "c" * 99, "é" * 60, "d"])
    parts = list(slices(texts, 100))
    assert len(parts) > 2 and pa.concat_arrays(parts).equals(texts)
    assert [len(p) for p in slices(texts[:0], 100)] == [0]
    assert [p.to_pylist() for p in slices(texts, 1 << 20)] == [texts.to_pylist()]
    beside = pa.array(range(len(texts)))
    assert [y for _, own in sliced(texts, beside) for y in own.to_pylist()] == list(range(len(texts)))


def test_a_tokenizer_is_given_a_bounded_amount_of_text_at_a_time(spark):
    most = 3 * SLICE_BYTES // 2

    class Counted(Wn.WordTokenizer):
        def __call__(self, texts):
            if sum(len(t) for t in texts) > most:
                raise ValueError("more than a slice")
            return super().__call__(texts)

    df = spark.range(400).selectExpr("id", "repeat(concat('word', id, ' '), 1000) as context").coalesce(1)
    assert Wn.token_offsets(df, factory=Counted).where("token = concat('word', id)").count() == 400_000


def test_a_result_leaves_before_the_next_slice(monkeypatch, spark):
    """The tokens of a whole batch were held, up to three times."""
    monkeypatch.setattr(batches.F, "arrow_udf", lambda kind: lambda work: work)
    done = []

    def start():
        def of(part):
            done.append(len(part))
            return part
        return of
    texts = pa.StructArray.from_arrays([pa.array(["x" * 1000, None] * 2000), pa.array(["y" * 1000] * 4000)], names=["a", "b"])
    out = batches.in_slices(iter([texts, texts]), "", start, batches._rows)
    first = next(out)
    assert done == [len(first)] and len(first) * 1500 <= SLICE_BYTES + 2000
    assert sum(map(len, out)) + len(first) == 8000
