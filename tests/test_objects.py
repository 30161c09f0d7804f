"""One-object JSON files: read by ranges and written by tasks."""

import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlake.sources import objects as O
from spanlake.sources.objects import Scanner, ranges_of, read_object_entries, run_through, write_object_entries

JSON = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(st.sampled_from('a"\\{}[],:\n é'), max_size=6),
                    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=6)


def by_ranges(path, n):
    """Both passes without Spark."""
    out, parts = [], ranges_of(path, n)
    for before, p in zip([None, *parts], parts):
        if before is not None:
            p.follow(before, *run_through(O.read_range(path, before.start, before.end - before.start), before.state))
        out += Scanner(p).entries()
    return out


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(st.sampled_from('k"\\{},é'), max_size=4), JSON, max_size=6), st.integers(1, 40),
       st.sampled_from([None, 1]), st.booleans())
def test_every_entry_once_at_any_cut(tmp_path_factory, obj, n, indent, ascii_only):
    path = str(tmp_path_factory.mktemp("o") / "x.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(" \n" + json.dumps(obj, indent=indent, ensure_ascii=ascii_only) + "\n ")
    got = by_ranges(path, n)
    assert [k for k, _ in got] == list(obj) and [json.loads(v) for _, v in got] == list(obj.values())


def test_several_tasks_read_one_file(spark, tmp_path):
    obj = {str(i): {"text": "a\"}{,\\" * (i % 7), "n": i} for i in range(500)}
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps(obj, ensure_ascii=False))
    df = read_object_entries(spark, str(path), range_bytes=1000)
    assert df.rdd.getNumPartitions() > 10
    assert {r["key"]: json.loads(r["value"]) for r in df.collect()} == obj
    assert df.count() == len(obj)
    assert len({r[0] for r in df.select(F.spark_partition_id()).distinct().collect()}) > 5


def test_folders_empty_objects_and_repeated_keys(spark, tmp_path):
    (tmp_path / "part=1").mkdir()
    (tmp_path / "_tmp").mkdir()
    (tmp_path / "part=1" / "a.json").write_text('{"a": 1, "a": [2, "x,"]}')
    (tmp_path / "b.json").write_text(" { } ")
    (tmp_path / "c.json").write_bytes(b'\xef\xbb\xbf{"\\u00e9\\"": null}')
    (tmp_path / "_tmp" / "d.json").write_text("nothing")
    for n in (3, 1 << 20):
        got = sorted(tuple(r) for r in read_object_entries(spark, str(tmp_path), n).collect())
        assert got == [("a", "1"), ("a", '[2, "x,"]'), ('é"', "null")]


@pytest.mark.parametrize("text", ["[1]", '{"a": 1', '{"a": 1,}', '{"a: 1}', "{1: 2}", '{"a" 1}', '{"a": 1} x', ""])
def test_what_is_no_object_is_an_error(tmp_path, text):
    path = tmp_path / "x.json"
    path.write_text(text)
    for n in (2, 100):
        with pytest.raises(ValueError):
            by_ranges(str(path), n)


def entries(spark, rows, parts=4):
    return spark.createDataFrame(rows, "key string, value string").repartitionByRange(parts, "key").sortWithinPartitions("key")


def test_tasks_write_one_file_in_order(spark, tmp_path):
    rows = [(f"{i:03d}é\"", json.dumps({"x": "ü" * i})) for i in range(50)] + [("zz", None)]
    path = str(tmp_path / "deep" / "out.json")
    write_object_entries(entries(spark, rows), path)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    assert json.loads(text) == {k: json.loads(v or "null") for k, v in rows} and list(json.loads(text)) == [k for k, _ in rows]
    assert os.listdir(tmp_path / "deep") == ["out.json"]
    write_object_entries(entries(spark, rows[:1]), path)
    assert len(json.load(open(path, encoding="utf-8"))) == 1
    with pytest.raises(Exception):
        write_object_entries(entries(spark, rows), path, mode="errorifexists")
    assert len(json.load(open(path, encoding="utf-8"))) == 1
    write_object_entries(entries(spark, rows).where("key is null"), path)
    assert json.load(open(path)) == {}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out.json")
    good = entries(spark, [(str(i), "1") for i in range(40)])
    write_object_entries(good, path)
    bad = good.withColumn("value", F.when(F.col("key") == "7", F.raise_error(F.lit("broken"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        write_object_entries(bad, path)
    assert os.listdir(tmp_path) == ["out.json"] and len(json.load(open(path))) == 40


def test_an_aborted_write_removes_the_files_of_killed_tasks(tmp_path):
    writer = O.ObjectWriter(f"{tmp_path}/out.json", True)
    other = tmp_path / "_out.json-other-00000-1"
    for path in (other, tmp_path / writer._own("00001-7").rpartition("/")[2]):
        path.write_text("left")
    writer.abort([None, None])
    assert list(tmp_path.iterdir()) == [other]
