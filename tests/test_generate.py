"""Generation, incremental runs, and reading and writing of records."""

import json

import pytest
from pyspark.sql import functions as F

from tablescribe.operators import catalog, generate as G
from tablescribe.plans import describe, evaluate, prompts
from tablescribe.sources import records


TEMPLATES = {kind: kind + "".join(f" {f}={{{f}}}" for f in fields) for kind, fields in prompts.FIELDS.items()}


def backend_factory(fail=None, log=None):
    """A stub backend: answers every prompt, raises where ``fail`` says so, and notes its calls in a file."""

    def make():
        def backend(batch, temperature):
            if log:
                with open(log, "a") as f:
                    f.write("call\n")
            if fail and (message := fail(batch[0])):
                raise RuntimeError(message)
            return [f" reply at {temperature} " for _ in batch]

        return backend

    return make


def calls(path):
    return len(path.read_text().splitlines()) if path.exists() else 0


def test_errors_stay_in_their_row(spark):
    df = spark.range(20).selectExpr("id", "'prompt ' || id AS prompt")
    out = G.generate(df, backend_factory(lambda p: "boom" if p.endswith("7") else None), ["id"], 0.5, concurrency=3).collect()
    assert {r.id for r in out if r.status == "error"} == {7, 17} and len(out) == 20
    assert {r.error for r in out} == {None, "RuntimeError: boom"}
    assert {r.reply for r in out} == {None, "reply at 0.5"}


def test_quota_stops_the_task(spark, tmp_path):
    log = tmp_path / "calls"
    df = spark.range(10).selectExpr("id", "'p' || id AS prompt")
    seen = []

    def make():
        def backend(batch, temperature):
            seen.append(batch[0])
            if len(seen) == 3:
                raise RuntimeError("HTTP 429: slow down")
            return ["x"]

        return backend

    out = G.generate(df, make, ["id"], concurrency=1).collect()
    counts = {s: sum(r.status == s for r in out) for s in ("ok", "error", "skipped_quota")}
    assert counts == {"ok": 2, "error": 1, "skipped_quota": 7}


def test_concurrency_bounds_the_tasks(spark):
    df = spark.range(1000).selectExpr("id", "'p' AS prompt")
    assert G.generate(df, backend_factory(), ["id"], concurrency=4).rdd.getNumPartitions() == 4


def test_temperature_per_row_and_pacing(spark):
    df = spark.createDataFrame([(1, "p", 0.0), (2, "p", 0.9)], "id int, prompt string, temperature double")
    out = {r.id: r.reply for r in G.generate(df, backend_factory(), ["id"], concurrency=1, min_interval=0.05).collect()}
    assert out == {1: "reply at 0.0", 2: "reply at 0.9"}


def make_files(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def make_registry(spark, *ids):
    rows = [(i, f"{i} of things here", f"about {i}", "", None, ["a"], 10, n) for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, "id string, name string, description string, category string, agency string, columns array<string>, page_views bigint, ord int")


def test_incremental_runs(spark, tmp_path):
    root = make_files(tmp_path / "csv", a="x,y\n1,u\n2,v\n", b="x\n1\n1\n", c="z\nq\n")
    reg, out, log = make_registry(spark, "a", "b", "c", "gone"), str(tmp_path / "out"), tmp_path / "calls"
    runs = str(tmp_path / "runs")

    def fail_b(prompt):
        return "backend down" if prompt.startswith("ufd_nyc") and '"dataset_id":"b"' in prompt else None

    first = describe.describe_collection(spark, reg, [root], out, backend_factory(fail_b, str(log)), TEMPLATES, run_log=runs, runtime_log=str(tmp_path / "times"))
    got = {r.dataset_id: (r.status, r.error) for r in first.collect()}
    assert got["a"][0] == got["c"][0] == "ok"
    assert got["b"] == ("error", "RuntimeError: backend down") and got["gone"][0] == "missing_csv"
    assert calls(log) == 3 + 3 + 2

    second = describe.describe_collection(spark, reg, [root], out, backend_factory(log=str(log)), TEMPLATES, run_log=runs)
    assert {r.dataset_id: r.status for r in second.collect()} == {"b": "ok", "gone": "missing_csv"}
    before = calls(log)
    third = describe.describe_collection(spark, reg, [root], out, backend_factory(log=str(log)), TEMPLATES, run_log=runs)
    assert {r.dataset_id: r.status for r in third.collect()} == {"gone": "missing_csv"} and calls(log) == before

    logged = spark.read.json(runs).orderBy("timestamp").collect()
    assert [r.new_ok_datasets for r in logged] == [2, 1, 0]
    assert logged[0].throughput_datasets_per_hour > 0 and logged[2].throughput_datasets_per_hour == 0
    assert spark.read.json(str(tmp_path / "times")).where("runtime_sec IS NOT NULL").count() == 3
    stored = [json.loads(line) for f in (tmp_path / "out").glob("part-*") for line in f.read_text().splitlines()]
    a = next(r for r in stored if r["dataset_id"] == "a")
    assert a["content_profile"]["num_rows"] == 2 and [c["name"] for c in a["semantic_profile"]["columns"]] == ["x", "y"]
    assert a["topic"] == "a of things" and a["ufd_nyc"] == a["sfd_nyc"] == "reply at 0.3"


def test_all_methods(spark, tmp_path):
    root = make_files(tmp_path / "csv", a="x,y\n1,u\n2,v\n")
    out = describe.describe_collection(
        spark, make_registry(spark, "a"), [root], str(tmp_path / "out"), backend_factory(), TEMPLATES, describe.ALL_METHODS, max_rows=1
    ).first()
    assert out.status == "ok" and out.HandS == "reply at 0.0" and out.sample == "x,y\n1,u\n"
    assert {out.ufd, out.sfd, out.ufd_nyc, out.sfd_nyc} == {"reply at 0.3"}
    assert out.content_profile.num_rows == 1


def test_judging_and_grading(spark):
    reg = make_registry(spark, *[f"d{i}" for i in range(12)])
    queries = spark.createDataFrame([("query_1", "one"), ("query_2", "two")], "query_id string, text string")

    def make():
        return lambda batch, temperature: ["Relevance: 2" if "query=one" in batch[0] else "none"]

    judged = evaluate.judge_relevance(reg, queries, make, TEMPLATES["relevance"], n_datasets=5)
    rows = judged.collect()
    assert len(rows) == 10 and {(r.query_id, r.rel) for r in rows} == {("query_1", 2), ("query_2", 0)}
    wide = records.relevance_wide(judged, ["query_1", "query_2"])
    assert wide.columns == ["dataset_id", "query_1", "query_2"] and wide.count() == 5

    base = spark.createDataFrame([("d1", "long enough", "tiny"), ("d2", "", None)], "dataset_id string, ufd string, sfd string")
    grades = evaluate.grade_texts(base.select("dataset_id"), reg, base, None, lambda: lambda b, t: ['{"readability": 5}'], TEMPLATES["grade"])
    got = {(r.dataset_id, r.method) for r in grades.collect()}
    assert got == {("d1", "original"), ("d1", "ufd"), ("d2", "original")}


def test_registry_and_queries(spark, tmp_path):
    entries = [{"id": "b", "name": "B", "columns": ["x", {"name": "y"}]}, {"id": "a", "page_views": 3, "columns": []}, {"id": "b", "name": "B2"}]
    (tmp_path / "registry.json").write_text(json.dumps(entries, indent=2))
    reg = records.read_registry(spark, str(tmp_path / "registry.json"))
    assert [r.id for r in reg.orderBy("ord").collect()] == ["b", "a", "b"]
    assert records.read_registry(spark, str(tmp_path / "registry.json"), 2).count() == 2
    assert {r.id: (r.ord, r.name) for r in records.last_by_key(reg, "id", "ord").collect()} == {"b": (0, "B2"), "a": (1, None)}
    assert reg.where("ord = 0").select(catalog.column_list(F.col("columns")).alias("c")).first().c == "x, y"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        records.read_registry(spark, str(tmp_path / "none.json"))
    (tmp_path / "queries.txt").write_text("  first query \n\n\t\nsecond\r\nthird\n")
    got = [tuple(r) for r in records.read_queries(spark, str(tmp_path / "queries.txt"), 2).orderBy("query_no").collect()]
    assert got == [(1, "query_1", "first query"), (2, "query_2", "second")]


def test_jsonl_and_slim(spark, tmp_path):
    lines = ['{"dataset_id": "a", "ufd": "1"}', "", "{broken", '{"dataset_id": "b"}', '{"dataset_id": "a", "ufd": "2", "title": "T"}']
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    rows = records.read_jsonl(spark, str(tmp_path / "r.jsonl"), records.RECORD_SCHEMA)
    assert sorted(r.dataset_id for r in rows.collect()) == ["a", "a", "b"]
    assert {r.dataset_id: r.ufd for r in records.last_by_key(rows, "dataset_id", "ord").collect()} == {"a": "2", "b": None}
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        records.read_jsonl(spark, str(tmp_path / "r.jsonl"), records.RECORD_SCHEMA, strict=True).collect()
    records.write_slim(rows, str(tmp_path / "slim"))
    back = spark.read.json(str(tmp_path / "slim"))
    assert sorted(back.columns) == ["dataset_id", "sfd_nyc", "title", "ufd_nyc"] and {r.ufd_nyc for r in back.collect()} == {""}


def test_relevance_and_results_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("dataset_id,query_1,query_2\n7,0,2\nx,1,0\n7,1,1\n")
    long = records.read_relevance(spark, str(tmp_path / "m.csv"))
    assert {(r.query_id, r.dataset_id): r.rel for r in long.collect()} == {
        ("query_1", "7"): 1, ("query_2", "7"): 1, ("query_1", "x"): 1, ("query_2", "x"): 0,
    }
    records.write_relevance(long, ["query_1", "query_2"], str(tmp_path / "wide"))
    assert spark.read.option("header", True).csv(str(tmp_path / "wide")).columns == ["dataset_id", "query_1", "query_2"]
    results = spark.createDataFrame([("ufd", "bm25@10", 0.5), ("ufd", "bm25@20", 0.25), ("hs", "bm25@10", 0.0)], records.RESULTS_SCHEMA)
    records.write_results(results, str(tmp_path / "results"))
    back = records.read_results(spark, str(tmp_path / "results"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, results.collect()))
    assert records.read_results(spark, str(tmp_path / "nothing")).count() == 0


def test_quota_stops_all_tasks(spark, tmp_path):
    log = tmp_path / "calls"

    def make():
        import os
        import time

        def backend(batch, temperature):
            with open(log, "a") as f:
                f.write("call\n")
            time.sleep(0.05)
            if os.path.getsize(log) >= 5 * 20:
                with open(log, "a") as f:
                    f.write("429!\n")
                raise RuntimeError("HTTP 429")
            return ["x"]

        return backend

    df = spark.range(2_000).selectExpr("id", "'p' || id AS prompt")
    out = G.generate(df, make, ["id"], concurrency=4).groupBy("status").count().collect()
    lines = log.read_text().splitlines()
    after = lines[lines.index("429!") :]
    assert after.count("call") <= 4
    counts = {r.status: r["count"] for r in out}
    assert sum(counts.values()) == 2_000 and counts["error"] <= 4 and counts["skipped_quota"] > 1_900


def test_pace_is_that_of_the_run(spark, tmp_path):
    times = tmp_path / "times"

    def make():
        import time

        def backend(batch, temperature):
            with open(times, "a") as f:
                f.write(f"{time.time()}\n")
            return ["x"]

        return backend

    df = spark.range(24).selectExpr("id", "'p' || id AS prompt")
    G.generate(df, make, ["id"], concurrency=4, min_interval=0.05).collect()
    at = sorted(map(float, times.read_text().split()))
    # Four tasks of about six calls: each one call in 0.2 seconds.
    assert len(at) == 24 and at[-1] - at[0] >= 0.05 * 24 * 0.6


def test_kept_replies_are_not_asked_again(spark, tmp_path):
    log, keep = tmp_path / "calls", str(tmp_path / "keep")
    df = spark.range(50).selectExpr("id", "'p' || id AS prompt")
    first = {r.id: (r.reply, r.status) for r in G.generate(df, backend_factory(lambda p: "boom" if p == "p7" else None, str(log)), ["id"], concurrency=2, keep=keep).collect()}
    assert calls(log) == 50
    kept = G.kept_replies(df, keep, ["id"]).collect()
    assert {r.id for r in kept} == set(range(50)) - {7} and {r.status for r in kept} == {"ok"}
    # A task that is tried again has the same folder; half a line at a file's end is no reply.
    (tmp_path / "keep" / "0" / "broken.json").write_text('{"id": 3, "na')
    second = {r.id: (r.reply, r.status) for r in G.generate(df, backend_factory(log=str(log)), ["id"], concurrency=2, keep=keep).collect()}
    assert calls(log) == 51
    assert {i: second[i] for i in range(50) if i != 7} == {i: first[i] for i in range(50) if i != 7} and second[7][1] == "ok"


def test_a_collection_is_parsed_once(spark, tmp_path, monkeypatch):
    from tablescribe.sources import collection

    root = make_files(tmp_path / "csv", **{f"t{i}": f"x,y\n{i},u\n" for i in range(7)}, other="not,chosen\n")
    reads = []
    inner = collection._read_rows
    monkeypatch.setattr(collection, "_read_rows", lambda *a: (reads.append(a[1]), inner(*a))[1])
    out = describe.describe_collection(spark, make_registry(spark, *[f"t{i}" for i in range(7)]), [root], str(tmp_path / "out"), backend_factory(), TEMPLATES, batch_datasets=2)
    assert {r.dataset_id: r.status for r in out.collect()} == {f"t{i}": "ok" for i in range(7)}
    assert len(reads) == 1 and sorted(p.rsplit("/", 1)[1] for p in reads[0]) == [f"t{i}.csv" for i in range(7)]


KILLED = """
import sys, time
sys.path[:0] = [{repo!r}]
from tablescribe.plans import describe, prompts
from tablescribe.session import local_session
templates = {{kind: kind + "".join(f" {{f}}={{{{{{f}}}}}}" for f in fields) for kind, fields in prompts.FIELDS.items()}}
spark = local_session(3, **{{"spark.checkpoint.dir": {work!r}}})
rows = [(f"t{{i}}", f"t{{i}}", "", "", None, ["a"], 10, i) for i in range(12)]
reg = spark.createDataFrame(rows, "id string, name string, description string, category string, agency string, columns array<string>, page_views bigint, ord int")

def make():
    def backend(batch, temperature):
        time.sleep(0.7)
        with open({log!r}, "a") as f:
            f.write(batch[0][:12].replace("\\n", " ") + str(hash(batch[0])) + "\\n")
        return ["reply"]
    return backend

describe.describe_collection(spark, reg, [{root!r}], {out!r}, make, templates, concurrency=3)
print("done")
"""


def test_a_killed_run_repeats_one_call_a_task(tmp_path):
    """The process group of a run is killed in the middle of a step; the next run asks again at most for the calls under way."""
    import os
    import signal
    import subprocess
    import sys
    import time

    root = make_files(tmp_path / "csv", **{f"t{i}": f"x,y\n{i},u\n" for i in range(12)})
    log = tmp_path / "calls"
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = KILLED.format(repo=repo, root=root, out=str(tmp_path / "out"), work=str(tmp_path / "work"), log=str(log))
    env = {**os.environ, "PYTHONHASHSEED": "0", "PYTHONPATH": repo}

    def start():
        return subprocess.Popen([sys.executable, "-c", script], env=env, start_new_session=True, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)

    first = start()
    until = time.time() + 240
    while calls(log) < 17 and time.time() < until:  # 12 of the first step, and some of the second
        time.sleep(0.05)
    time.sleep(0.1)
    os.killpg(first.pid, signal.SIGKILL)
    first.wait()
    asked = calls(log)
    assert 17 <= asked < 24
    second = start()
    output, _ = second.communicate(timeout=400)
    assert b"done" in output
    lines = log.read_text().splitlines()
    # 36 calls in all: three steps of twelve datasets. A task repeats the call under way, and one that was not written down yet.
    assert 36 <= len(lines) <= 36 + 2 * 3
