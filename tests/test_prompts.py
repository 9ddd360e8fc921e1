"""Samples, limits and prompts."""

import pytest
from pyspark.sql import functions as F

from tablescribe.functions.text import cap_block, cap_domain_block, cap_prompt
from tablescribe.operators.catalog import column_list, is_quota_error, topic
from tablescribe.plans import prompts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def cells_of(spark, columns):
    rows = [("d", i, c, name, v) for c, (name, values) in enumerate(columns.items()) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "dataset_id string, row_idx bigint, col_idx int, col_name string, value string")


def test_sample_leaves_out_huge_and_surplus_columns(spark):
    columns = {f"c{i}": [str(i), None] for i in range(12)}
    columns["c3"] = ["x" * 2001, "y"]
    columns["c4"] = ["x" * 2000, 'a,"b"\nc']
    text = prompts.sample_csv(cells_of(spark, columns)).first().sample
    header = text.split("\n")[0]
    assert header == "c0,c1,c2,c4,c5,c6,c7,c8,c9,c10"
    assert text.endswith(',,,"a,""b""\nc",,,,,,\n')


def test_sample_of_huge_only_empty_and_single(spark):
    huge = prompts.sample_csv(cells_of(spark, {"a": ["x" * 2001]})).first().sample
    assert huge == "# Sample omitted: all columns have very large cell values in the first 5 rows.\n"
    empty = spark.createDataFrame([("d", None, 0, "a", None)], "dataset_id string, row_idx bigint, col_idx int, col_name string, value string")
    assert prompts.sample_csv(empty).first().sample == ""
    assert prompts.sample_csv(cells_of(spark, {"a": [None, "1"]})).first().sample == 'a\n""\n1\n'
    seven = prompts.sample_csv(cells_of(spark, {"a": list("1234567")})).first().sample
    assert seven == "a\n1\n2\n3\n4\n5\n"


@pytest.mark.parametrize("size", [8000, 8001])
def test_blocks(spark, size):
    text = F.lit("é" * size)
    block, domain = one(spark, cap_block(text, 8000, "profile")), one(spark, cap_domain_block(text, 8000))
    if size == 8000:
        assert block == domain == "é" * 8000
    else:
        assert block == "é" * 8000 + "\n...[profile truncated at 8000 chars]..."
        assert domain == "é" * 8000 + "...(truncated)"


def test_prompt_limit(spark):
    assert one(spark, cap_prompt(F.lit("x" * 120_000))) == "x" * 120_000
    cut = one(spark, cap_prompt(F.lit("x" * 120_001)))
    assert cut == "x" * 120_000 + "\n\n...[prompt truncated from 120001 to 120000 chars]..."
    with pytest.raises(Exception, match="prompt too long"):
        one(spark, cap_prompt(F.lit("x" * 120_001), strict=True))


def test_size_ladder(spark):
    template = "{topic}|{sample}|{content_profile}|{semantic_profile}"

    def prompt(sample, content):
        return one(spark, prompts.user_focused_prompt(F.lit("t"), F.lit(sample), F.lit(content), F.lit("s"), template, 60_000))

    exact = "x" * (60_000 - len("t||c|s"))
    assert prompt(exact, "c") == f"t|{exact}|c|s"
    assert prompt(exact + "x", "c") == "t|# Sample omitted due to size limits.\n|c|s"
    long = one(spark, prompts.user_focused_prompt(F.lit("t"), F.lit("x" * 50), F.lit("c" * 9000), F.lit("s"), template, 5000))
    assert long == "t|# Sample omitted due to size limits.\n|" + "c" * 4000 + "\n...[content_profile truncated at 4000 chars]...|s"


def test_templates_fill_every_field(spark):
    text = one(spark, prompts.fill("{{a}} {b}-{b} {c}", b=F.lit(1), c=F.lit(None).cast("string")))
    assert text == "{a} 1-1 "
    df = spark.createDataFrame([(None, None, "T")], "agency string, category string, topic string")
    p = df.select(prompts.domain_user_prompt(F.lit("S"), F.lit("C"), F.lit("M"), "{agency} {category} {topic}").alias("p")).first().p
    assert "NYC Agency" in p and "General" in p and "{" not in p


def test_semantic_prompt_cuts_examples(spark):
    rows = [("d", 1, "b", "text", ["y" * 301]), ("d", 0, "a", "numeric", [str(i) for i in range(12)])]
    chosen = spark.createDataFrame(rows, "dataset_id string, col_idx int, name string, coarse_type string, example_values array<string>")
    text = prompts.semantic_prompt(chosen, "{column_blocks}", "{name}:{coarse}:{examples}").first().prompt
    first, second = text.split("\n")
    assert first == 'a:numeric:["0","1","2","3","4","5","6","7","8","9"]'
    assert second == 'b:text:["' + "y" * 300 + '...[truncated]"]'


def test_topics_and_column_lists(spark):
    rows = [("Health", "n"), ("", " Taxi\ttrips  in town "), (None, "Two words"), (None, None), ("", "  ")]
    df = spark.createDataFrame(rows, "category string, name string")
    got = [r.t for r in df.select(topic(F.col("category"), F.col("name")).alias("t")).collect()]
    assert got == ["Health", "Taxi trips in", "Two words", "Unknown dataset", "Unknown dataset"]
    assert one(spark, column_list(F.array(F.lit("a"), F.lit('{"name": "b", "type": "t"}'), F.lit('{"type": "t"}')))) == 'a, b, {"type": "t"}'
    assert one(spark, column_list(F.lit(None).cast("array<string>"))) == ""


def test_quota_errors(spark):
    rows = [("HTTP 429",), ("Quota used up",), ("Limit EXCEEDED",), ("timeout",), (None,)]
    df = spark.createDataFrame(rows, "e string")
    assert [r.q for r in df.select(is_quota_error(F.col("e")).alias("q")).collect()] == [True, True, True, False, False]
