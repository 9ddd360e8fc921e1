"""What would grow faster than the input, or by a number of tasks, files or steps that does not follow it."""

import gzip

from pyspark.sql import functions as F


def test_records_of_damaged_files_widen_no_reader(spark, tmp_path, monkeypatch):
    from tablescribe.operators import profile as P
    from tablescribe.sources import collection

    # What a changed bit makes of line breaks: a record of thousands of fields, behind a header of three.
    garbage = gzip.compress(("a,b,c\n1,2,3\n" + ",".join("x" * 5_000) + "\n" + "4,5,6\n" * 400_000).encode(), mtime=0)
    (tmp_path / "garbage.csv.gz").write_bytes(garbage[:-8] + bytes(8))
    wide = ",".join(f"c{i}" for i in range(100))
    (tmp_path / "wide.csv.gz").write_bytes(gzip.compress((f"{wide}\n" * 8_000).encode())[:-8] + bytes(8))
    widths, inner = [], collection._read_rows
    monkeypatch.setattr(collection, "_read_rows", lambda *a: (widths.append(a[2]), inner(*a))[1])
    staged = collection.stage_collection(spark, str(tmp_path), r"([^/]+)\.csv\.gz$")
    assert widths == [65, 513]
    got = {r.dataset_id: (r.status, r.error) for r in P.minimal_profile(staged).collect()}
    assert got == {n: ("error", collection.DAMAGED) for n in ("garbage", "wide")}
    heads = {r.dataset_id: len(r.header) for r in staged.where(F.col("row_idx") == -1).collect()}
    assert heads == {"garbage": 3, "wide": 100}
    assert staged.where("n_fields > size(header)").select("dataset_id").distinct().collect()[0].dataset_id == "garbage"


def test_many_keywords_are_found_in_one_pass(spark, monkeypatch):
    import random

    from tablescribe.operators import triage as T

    rng = random.Random(3)
    words = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["the", "The", "x", "ab", "abab", "ababab", "naïve", "日本", "no such"]
    texts = ["".join(rng.choice("abéx 日本") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "the", "NAÏVE", "日", "ab" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    wanted = T.normalize_keywords(words)
    assert len(wanted) > T.FEW_KEYWORDS
    monkeypatch.setattr(T, "CHUNK_BYTES", 200)
    score = T.keyword_score(F.col("text"), words)
    got = {r.id: r.score for r in df.select("id", score.alias("score")).collect()}
    assert got == {i: sum(k in (t or "").lower() for k in wanted) for i, t in enumerate(texts)}
    # One look at a text, not one for each keyword.
    assert "filter(" not in str(score)


def test_document_frequencies_shuffle_a_word_once_a_task(spark):
    from tablescribe.operators import ranking as R

    rows = [("m", "a", "x y x"), ("m", "a", "x z"), ("m", "b", "x  y"), ("n", "a", "y"), ("m", None, "x x"), ("m", None, "y"), ("n", "c", None), ("n", "d", "")]
    texts = spark.createDataFrame(rows, "method string, dataset_id string, text string")
    got = {(r.method, r.term): (r.df, r.cf) for r in R.document_frequencies(texts).collect()}
    assert got == {("m", "x"): (3, 6), ("m", "y"): (3, 3), ("m", "z"): (1, 1), ("n", "y"): (1, 1)}
    many = spark.range(3_000).selectExpr("'m' AS method", "CAST(id AS string) AS dataset_id", "'one two three three' AS text").repartition(4)
    assert R.combined_terms(many).count() == 4 * 3
    assert {(r.term, r.df, r.cf) for r in R.document_frequencies(many).collect()} == {("one", 3_000, 3_000), ("two", 3_000, 3_000), ("three", 3_000, 6_000)}


def test_ideal_dcg_ranks_counts(spark):
    import math

    from tablescribe.operators import ranking as R

    rels = [2, 2, 0, None, 1, 1, 1, 0, -1, 2]
    judged = spark.createDataFrame([("q", f"d{i}", r) for i, r in enumerate(rels)] + [("q", "gone", 2), ("none", "d0", None), ("twice", "d0", 1), ("twice", "d0", 1)], "query_id string, dataset_id string, rel int")
    docs = spark.createDataFrame([(f"d{i}",) for i in range(10)], "dataset_id string")
    got = {(r.query_id, r.k): r.ideal for r in R.ideal_dcg(judged, docs, [4, 20]).collect()}
    order = sorted((r for r in rels if r is not None), reverse=True)
    want = {k: sum(r / math.log2(i + 2) for i, r in enumerate(order[:k])) for k in (4, 20)}
    assert all(abs(got["q", k] - want[k]) < 1e-12 for k in want) and got["none", 4] is None
    assert abs(got["twice", 4] - (1 + 1 / math.log2(3))) < 1e-12
    # A row for each different relevance is ranked, not one for each judgement.
    plan = R.ideal_dcg(judged, docs, [4])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate [query_id", plan.index("Window"))


def test_few_calls_at_once_are_asked_in_rounds(spark, tmp_path, monkeypatch):
    from tablescribe.operators import generate as G

    monkeypatch.setattr(G, "TASK_BYTES", 1_000)
    log = tmp_path / "calls"

    def make():
        def backend(batch, temperature):
            with open(log, "a") as f:
                f.write("call\n")
            if batch[0].endswith(" 399"):
                raise RuntimeError("HTTP 429")
            return [batch[0][-3:]]

        return backend

    df = spark.range(100).selectExpr("id", "IF(id = 7, NULL, repeat('x', 96) || ' ' || (100 + id)) AS prompt")
    out = G.generate(df.where("id != 7"), make, ["id"], concurrency=2)
    got = {r.id: (r.reply, r.status) for r in out.collect()}
    assert got == {i: (str(100 + i), "ok") for i in range(100) if i != 7}
    assert sorted(r.id for r in out.collect()) == [i for i in range(100) if i != 7] and len(log.read_text().splitlines()) == 99
    # About 10,100 bytes: six rounds of two tasks, each given less than 1,000.
    keep = str(tmp_path / "keep")
    G.generate(df, make, ["id"], concurrency=2, keep=keep)
    assert len(list((tmp_path / "keep").iterdir())) == 12
    # The end of the quota in one round ends the later ones too.
    quota = df.selectExpr("id", "repeat('x', 96) || ' 399' AS prompt")
    states = [r.status for r in G.generate(quota, make, ["id"], concurrency=2).collect()]
    assert states.count("error") in (1, 2) and states.count("skipped_quota") == 100 - states.count("error")


def test_replies_are_read_once_a_run(spark, tmp_path, monkeypatch):
    from test_generate import TEMPLATES, backend_factory, calls, make_files, make_registry

    from tablescribe.plans import describe

    root = make_files(tmp_path / "csv", **{f"t{i}": f"x,y\n{i},u\n" for i in range(6)})
    reads, inner, log = [], describe.stored_replies, tmp_path / "calls"
    monkeypatch.setattr(describe, "stored_replies", lambda *a: (reads.append(a), inner(*a))[1])
    reg, out = make_registry(spark, *[f"t{i}" for i in range(6)]), str(tmp_path / "out")
    fail = backend_factory(lambda p: "down" if p.startswith("sfd_nyc") else None, str(log))
    first = describe.describe_collection(spark, reg, [root], out, fail, TEMPLATES, batch_datasets=2)
    assert {r.status for r in first.collect()} == {"error"} and calls(log) == 18
    second = describe.describe_collection(spark, reg, [root], out, backend_factory(log=str(log)), TEMPLATES, batch_datasets=2)
    assert {r.dataset_id: r.status for r in second.collect()} == {f"t{i}": "ok" for i in range(6)}
    # Only what failed is asked again, and the replies are looked up once in each run.
    assert calls(log) == 24 and len(reads) == 2


def test_csv_files_hold_the_tables_values(spark, tmp_path):
    import datetime

    from queryset import tables

    day = datetime.datetime(2024, 1, 2)
    texts = ['a "b", c', "x\ny", " out er ", "", None, "#no comment", "é\\", '"']
    spark.createDataFrame([(i, 7, 1.5, day, "5-LOW", "O") for i in range(250)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string, o_orderstatus string").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(None, "lost", 3), (5, "kept", 7)], "c_custkey long, c_name string, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(i, "en", "s", t, 1) for i, t in enumerate(texts)], "doc_id long, lang string, source string, text string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    folder = tables.csv_collection(spark, str(tmp_path))
    # Written by the tasks, one file a dataset.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part.csv").load(folder).select("path").collect()
    assert sorted(r.path.split("dataset_id=")[1].split("/")[0] for r in files) == sorted(["orders-0", "orders-1", "orders-2", "customer-0", "documents-0", tables.NO_ID])
    rows = tables.staged(spark, str(tmp_path)).where("row_idx >= 0")
    got = {r.row_idx: r.fields[3] for r in rows.where("dataset_id = 'documents-0'").collect()}
    assert {i: v or None for i, v in got.items()} == {i: t or None for i, t in enumerate(texts)}
    assert rows.where("dataset_id LIKE 'orders%' AND n_fields = 6").count() == 250
    assert rows.where(F.col("dataset_id") == tables.NO_ID).collect()[0].fields[:2] == [None, "lost"]


def test_many_small_files_cost_little_each(spark, tmp_path):
    from tablescribe.operators import profile as P
    from tablescribe.sources import collection

    for i in range(40):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / f"t{i}.csv").write_text(f"a,b,,c\n{i},,,\n\"x\ny\",\"\"\"q\"\"\"\n1,2,3,4\n")
    # Only the 65th field of a record has no value: it is wider than its table all the same, whatever is quoted behind.
    ragged = ["1"] + [""] * 69 + ['"l\n""m"""']
    (tmp_path / "d0" / "ragged.csv").write_text("a,b\n" + ",".join(ragged) + "\n3,4\n")
    before = spark.conf.get(collection._LISTING_CONF)
    seen, inner = [], collection._read_rows
    with collection._few_listing_tasks(spark):
        assert int(spark.conf.get(collection._LISTING_CONF)) == collection.LISTING_TASKS * spark.sparkContext.defaultParallelism < int(before)
    assert spark.conf.get(collection._LISTING_CONF) == before
    rows = collection._read_rows(spark, [str(tmp_path)], 65, True, True)
    # What is read are fewer columns than the reader is told of, so that it fills in those that a record lacks.
    assert "_rest" not in rows._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert {len(r.fields) for r in rows.where("path NOT LIKE '%ragged%'").collect()} == {1, 2, 4}
    assert {r.fields[0] for r in rows.where("full").collect()} == {"1"}
    staged = collection.stage_collection(spark, str(tmp_path))
    got = [[*r.fields] for r in staged.where("dataset_id = 't7'").orderBy("row_idx").collect()]
    assert got == [["a", "b", "Unnamed: 2", "c"], ["7", None, None, None], ["x\ny", '"q"', None, None], ["1", "2", "3", "4"]]
    status = {r.dataset_id: (r.status, r.row_count, r.error) for r in P.minimal_profile(staged).collect()}
    assert status["t7"] == ("ok", 3, None) and status["ragged"] == ("error", None, "expected 2 fields, saw 71") and len(status) == 41


def test_plain_files_are_parsed_by_tasks(spark, tmp_path, monkeypatch):
    from tablescribe.sources import collection

    texts = ["a,b\n1,2\n", 'a,,a\n"x\ny","q""z",\n\n,,\n', "a\n\"\"\n \n", "h\n", "a,b\n1,2,3\n", 'é,"  s  "\n#c, d ']
    odd = ['a,b\n1,x"y\n', "a,b\r\n1,2\r\n", 'a,b\n"1,2\n']
    for i, text in enumerate(texts + odd):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / f"t{i}.csv").write_text(text, newline="")
    (tmp_path / "_hidden.csv").write_text("a\n1\n")
    (tmp_path / "empty.csv").write_text("")
    seen, inner = [], collection._spark_rows
    monkeypatch.setattr(collection, "_spark_rows", lambda *a: (seen.append(sorted(p.rsplit("/", 1)[1] for p in a[1])), inner(*a))[1])
    got = collection._read_rows(spark, [str(tmp_path)], 65, True, True).collect()
    # Spark's reader opens only what it takes Spark's reader to understand.
    assert seen == [["t6.csv", "t7.csv", "t8.csv"]]
    want = inner(spark, [str(tmp_path)], 65, True, True).collect()

    def by_file(rows):
        return {p: [(r.full, r.fields) for r in sorted(rows, key=lambda r: r.at) if r.path == p] for p in {r.path for r in rows}}

    assert by_file(got) == by_file(want) and len(by_file(got)) == 9
    listed = collection.list_files(spark, [str(tmp_path)]).collect()
    assert len(listed) == 9 and all(r.path.startswith("file:/") and r.length for r in listed)


def test_datasets_are_profiled_once_a_run(spark, tmp_path, monkeypatch):
    from test_generate import TEMPLATES, backend_factory, make_files, make_registry

    from tablescribe.plans import describe

    root = make_files(tmp_path / "csv", bad="a\n1,2\n", **{f"t{i}": f"x,y\n{i},u\n" for i in range(5)})
    profiled, inner = [], describe.profile_cells
    monkeypatch.setattr(describe, "profile_cells", lambda *a: (profiled.append(1), inner(*a))[1])
    reg, out = make_registry(spark, "bad", *[f"t{i}" for i in range(5)]), str(tmp_path / "out")
    first = describe.describe_collection(spark, reg, [root], out, backend_factory(), TEMPLATES, batch_datasets=2)
    assert {r.dataset_id: r.status for r in first.collect()} == {"bad": "error", **{f"t{i}": "ok" for i in range(5)}}
    assert len(profiled) == 1
    # Nothing but a file that cannot be read is left.
    second = describe.describe_collection(spark, reg, [root], out, backend_factory(), TEMPLATES, batch_datasets=2)
    assert {r.dataset_id: (r.status, r.error) for r in second.collect()} == {"bad": ("error", "expected 1 fields, saw 2")}
