"""Inventories split within a file: the same rows as read whole."""

import os
import random

import pytest

from rollcall.sources.inventory import read_inventory

TEXTS = ["10.0.0.1", "a}b", "{", "]", "[ {", "/* x", "*/", "// no comment", "it's", "é}", "", "},"]


def _escaped(rng):
    return rng.choice(['\\"', "\\\\", '\\"}', "\\\\}", "\\u007d", "}\\\\"])


def _string(rng):
    return '"' + "".join(rng.choice(TEXTS) if rng.random() < 0.7 else _escaped(rng)
                         for _ in range(rng.randrange(3))) + '"'


def _gap(rng):
    return rng.choice(["", " ", "\n", "/* } */", "/* \" { ' */", "// } ' \" [\n", "/***/", "/* ** } **/", " // [ {\r\n"])


def _object(rng, depth=0):
    fields = [f'"IP"{_gap(rng)}:{_gap(rng)}{_string(rng)}', f'"isMaster": {rng.choice(["true", "false", "null"])}',
              f'"path": {_string(rng)}', "'vmware': 'say \"}\" \\' }'"]
    if depth < 2 and rng.random() < 0.4:
        nested = ", ".join(_object(rng, depth + 1) for _ in range(rng.randrange(3)))
        fields.append(f'"more": [{nested}]')
        fields.append(f'"other": {{"x": {_object(rng, depth + 1)}}}')
    rng.shuffle(fields)
    return "{" + (_gap(rng) + "," + _gap(rng)).join(fields[:rng.randrange(len(fields) + 1)]) + _gap(rng) + "}"


def _array(rng, n):
    parts = [rng.choice([_object(rng), _object(rng), _object(rng), "null"]) for _ in range(n)]
    return (_gap(rng) + "[" + _gap(rng) + (_gap(rng) + "," + _gap(rng)).join(parts) + _gap(rng) + "]"
            + rng.choice(["", "\n", "/* } */", " // [ }"]))


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
        f.write(text)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture()
def tiny_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ["97b", "1b"]):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_arrays_cut_anywhere(spark, scratch, tiny_splits, seed):
    rng = random.Random(seed)
    for i in range(12):
        _write(scratch, f"c{i}.json", _array(rng, rng.randrange(12)))
    whole = _rows(read_inventory(spark, scratch, split=False))
    assert len(whole) > 20
    assert _rows(read_inventory(spark, scratch, split=True)) == whole


def test_edges(spark, scratch, tiny_splits):
    files = {"empty": "", "none": "[]", "comments": "/* {} */ [ /* } */ ] // {}", "nulls": "[null, null]",
             "object": '{"IP": "1", "x": {"y": {}}, "MAC": "m"}', "long": '[{"IP": "' + "}x{" * 400 + '"}, {"MAC": "m"}]',
             "behind": '[{"IP": "1"}] {"IP": "2"}', "tail": '[{"IP": "1"}, null]'}
    for name, text in files.items():
        _write(scratch, name + ".json", text)
    assert _rows(read_inventory(spark, scratch, split=True)) == _rows(read_inventory(spark, scratch, split=False))


@pytest.mark.parametrize("text", [
    '[{"IP": "1"}, {"IP": "2"}', '[{"IP": "1"}, {"IP": "2"}, ]', '[{"IP": "1"} {"IP": "2"}]', '[{"IP": "1"}, {"IP": "2"',
    '[{"IP": "1"}, {"IP": }, {"IP": "3"}]', '[{"IP": "1"}, {"IP": "2]}', '[{"IP": "1"},, {"IP": "2"}]', '[{"IP": "1"'])
def test_malformed_files_fail_both_ways(spark, scratch, tiny_splits, text):
    _write(scratch, "bad.json", text)
    for split in (False, True):
        with pytest.raises(Exception):
            read_inventory(spark, scratch, split=split).collect()


def test_second_array_behind_the_first_is_an_error(spark, scratch, tiny_splits):
    _write(scratch, "two.json", '[{"IP": "1"}] [{"IP": "2"}, {"IP": "3"}]')
    with pytest.raises(Exception, match="ends before the file does"):
        read_inventory(spark, scratch, split=True).collect()


def test_large_file_is_read_by_many_tasks(spark, scratch):
    n = 40_000
    _write(scratch, "big.json", "/* big */ [" + ",\n".join(
        f'{{"IP": "10.{i}", "path": "C:\\\\}}{i} // x"}}' for i in range(n)) + "]")
    names = {"spark.sql.files.maxPartitionBytes": "200k", "rollcall.inventory.wholeFileBytes": "1000000"}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        got = read_inventory(spark, scratch)
        tasks = spark.read.option("lineSep", "}").text(scratch).rdd.getNumPartitions()
        assert tasks > 5
        assert [(r.idx, r.ip, r.path) for r in got.orderBy("idx").collect()] == [
            (i, f"10.{i}", f"C:\\}}{i} // x") for i in range(n)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("rollcall.inventory.wholeFileBytes")
