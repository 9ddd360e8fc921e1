"""Registries of several splits and files, and texts that are none."""

import json

import pytest
from pyspark.sql import functions as F

from tablescribe.sources import records


@pytest.fixture()
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


NASTY = ['a "quoted" }', "[{", "\\", 'x\\"y', "}{", "]", "é 日本 𐐷", "", "line\nfeed", '\\\\"', "a" * 3_000 + "}" * 50]


def entries(n):
    return [{"id": f"d{i}", "name": NASTY[i % len(NASTY)], "columns": ["x", {"name": NASTY[(i + 3) % len(NASTY)], "more": [{"deep": "}"}]}], "page_views": i, "extra": {"a": [1, {"b": "]"}]}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_a_registry_of_many_splits(spark, tmp_path, small_splits, indent):
    want = entries(300)
    path = tmp_path / "registry.json"
    path.write_text(json.dumps(want, indent=indent, ensure_ascii=bool(indent)), encoding="utf-8")
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 20
    got = records.read_registry(spark, str(path)).orderBy("ord").collect()
    assert [(r.ord, r.id, r.name, r.page_views) for r in got] == [(i, e["id"], e["name"], i) for i, e in enumerate(want)]
    assert [json.loads(r.columns[1])["name"] for r in got] == [e["columns"][1]["name"] for e in want]
    assert records.read_registry(spark, str(path), 7).count() == 7


def test_a_registry_of_several_files(spark, tmp_path):
    want = entries(40)
    lines = [json.dumps(e) for e in want]
    for k in range(4):
        part = ",\n".join(lines[10 * k : 10 * k + 10])
        (tmp_path / f"part-{k}.json").write_text(("[" if not k else "") + part + (",\n" if k < 3 else "\n]\n"))
    got = records.read_registry(spark, str(tmp_path)).orderBy("ord").select("id").collect()
    assert [r.id for r in got] == [e["id"] for e in want]


@pytest.mark.parametrize("text", ["[]", " [ \n ] "])
def test_an_empty_registry(spark, tmp_path, text):
    (tmp_path / "r.json").write_text(text)
    assert records.read_registry(spark, str(tmp_path / "r.json")).count() == 0


@pytest.mark.parametrize("text", ['{"id": "a"}', '[{"id": "a"}', '[{"id": "a"}] x', '[{"id": "a"} {"id": "b"}]', "[1, 2]", "", "nothing", '[{"id": "a"}]]', '[{"id": "a"},]', '[{"id": "a", "b": [}]'])
def test_no_registry(spark, tmp_path, text):
    (tmp_path / "r.json").write_text(text)
    with pytest.raises(Exception, match="no JSON array|MALFORMED"):
        records.read_registry(spark, str(tmp_path / "r.json")).select(F.count("id")).collect()
