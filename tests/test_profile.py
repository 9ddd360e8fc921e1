"""Column profiles on small hand-made tables, and exact quartiles against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tablescribe.operators import profile as P
from tablescribe.operators.semantic import choose_columns
from tablescribe.sources import collection
from tablescribe.sources.collection import FILE_STEM, collection_cells, collection_status, list_csv_files, resolve_csv_paths, stage_collection


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, newline="")
    return str(folder)


def profiles(spark, folder, **options):
    staged = stage_collection(spark, folder, **options)
    rows = P.profile_cells(collection_cells(staged)).collect()
    return {(r.dataset_id, r.name): r for r in rows}


def cells_of(spark, columns):
    """Cells of one dataset from ``{name: [text, ...]}``."""
    rows = [("d", i, c, name, v) for c, (name, values) in enumerate(columns.items()) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "dataset_id string, row_idx bigint, col_idx int, col_name string, value string")


def test_quoted_line_breaks_and_ragged_collection(spark, tmp_path):
    folder = write(
        tmp_path,
        one='a,b,c\n1,"x\ny",true\n2,NA,\n3,"q""z",false\n',
        two="k,v,w,z\np,1,2,3\nq,4,5\n",
    )
    staged = stage_collection(spark, folder)
    minimal = {r.dataset_id: r for r in P.minimal_profile(staged).collect()}
    assert (minimal["one"].row_count, minimal["one"].column_count, minimal["one"].columns) == (3, 3, ["a", "b", "c"])
    assert (minimal["two"].row_count, minimal["two"].columns) == (2, ["k", "v", "w", "z"])
    got = profiles(spark, folder)
    b = got["one", "b"]
    assert (b.num_rows, b.num_non_null, b.num_unique, b.example_values) == (3, 2, 2, ["x\ny", 'q"z'])
    assert b.null_fraction == pytest.approx(1 / 3)
    c = got["one", "c"]
    assert (c.coarse_type, c.inferred_dtype, c.num_non_null) == ("boolean", "boolean", 2)
    z = got["two", "z"]
    assert (z.coarse_type, z.inferred_dtype, z.num_non_null, z.example_values) == ("numeric", "double", 1, ["3.0"])


def test_all_null_header_only_and_single_value(spark, tmp_path):
    folder = write(tmp_path, nulls="a,b\n,1\n,2\n,3\n,4\n", bare="a,b\n", single="a,k\n5,w\n,x\n,y\n,z\n")
    got = profiles(spark, folder)
    a = got["nulls", "a"]
    assert (a.coarse_type, a.num_non_null, a.num_unique, a.null_fraction, a.example_values) == ("numeric", 0, 0, 1.0, [])
    assert a.stats.min is None and a.stats.p50 is None
    bare = got["bare", "b"]
    assert (bare.coarse_type, bare.num_rows, bare.null_fraction) == ("text", 0, None)
    one = got["single", "a"].stats
    assert (one.min, one.max, one.mean, one.p50, one.std) == (5.0, 5.0, 5.0, 5.0, None)


def test_number_rules(spark):
    cells = cells_of(
        spark,
        {
            "ints": ["1", "2", "3", "3"],
            "suffix": ["1d", "2f", "3", "4"],
            "zeros": ["007", "7", "7.0", "8"],
            "flags": ["True", "False", "true", "TRUE"],
            "tied": ["x", "y", "y", "x"],
            "signed": ["-1e3", "+.5", "inf", "2."],
            "big": ["9007199254740993", "9007199254740992", "1", "2"],
        },
    )
    got = {r.name: r for r in P.profile_cells(cells).collect()}
    ints = got["ints"]
    assert (ints.inferred_dtype, ints.num_unique, ints.example_values) == ("bigint", 3, ["1", "2", "3", "3"])
    assert (ints.stats.mean, ints.stats.p25, ints.stats.p50, ints.stats.p75) == (2.25, 1.75, 2.5, 3.0)
    assert ints.stats.std == pytest.approx(0.957427, abs=1e-6)
    assert got["suffix"].coarse_type == "text"
    assert (got["zeros"].num_unique, got["zeros"].example_values[0]) == (2, "7.0")
    flags = got["flags"]
    assert flags.num_unique == 2 and [(t.value, t["count"]) for t in flags.stats.top_values] == [("True", 3), ("False", 1)]
    assert [(t.value, t["count"]) for t in got["tied"].stats.top_values] == [("x", 2), ("y", 2)]
    assert got["signed"].coarse_type == "numeric"
    assert got["big"].num_unique == 4


def test_quartiles_of_few_and_of_many_distinct_values(spark):
    df = spark.range(1_000_000).select("id", (F.col("id") * 0.5).alias("many"), F.lit(3).alias("one"))
    profile = P.profile_table(df, "t", ["id"])
    got = {r.name: r.stats for r in profile.collect()}
    assert (got["many"].p25, got["many"].p50, got["many"].p75) == (124_999.875, 249_999.75, 374_999.625)
    assert (got["one"].p25, got["one"].p50, got["one"].p75) == (3.0, 3.0, 3.0)
    assert "percentile" not in profile._jdf.queryExecution().toString()


def test_smallest_long_and_scans_of_nullable_columns(spark):
    df = spark.createDataFrame([(1, -(2**63)), (2, -(2**63) + 1), (3, None)], "id long, v long")
    assert {r.name: r.num_unique for r in P.profile_table(df, "t", ["id"]).collect()}["v"] == 2

    def scans(n, path):
        spark.range(20).select("id", *[F.when(F.col("id") % 7 != i % 7, F.col("id")).alias(f"c{i}") for i in range(n)]).write.parquet(path)
        table = spark.read.parquet(path)
        examples = P.table_examples(table, "t", ["id"], P.table_facts(table, "t"))
        return examples._jdf.queryExecution().executedPlan().toString().count("FileScan")

    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        assert scans(2, f"{folder}/a") == scans(50, f"{folder}/b")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 30_001])
def test_quartiles_are_exact(spark, n):
    rng = random.Random(n)
    draw = {
        "uniform": lambda: rng.random() * 1000,
        "skewed": lambda: float(int(rng.paretovariate(0.7))),
        "hot": lambda: 5.0 if rng.random() < 0.4 else float(rng.randint(0, 9)),
        "huge": lambda: rng.uniform(-1e300, 1e300),
    }
    df = spark.createDataFrame([(i, *[f() for f in draw.values()]) for i in range(n)], "id bigint, " + ", ".join(f"{d} double" for d in draw))
    got = {r.name: r.stats for r in P.profile_table(df, "t", ["id"]).collect()}
    for name in draw:
        want = df.agg(F.percentile(name, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
        assert [got[name].p25, got[name].p50, got[name].p75] == pytest.approx(want, rel=1e-12)


def test_typed_kinds(spark):
    df = spark.sql(
        "SELECT id, id % 2 = 0 AS flag, date_add(DATE '2020-01-01', int(id)) AS day, array(id, 1) AS list, "
        "CAST(id AS DECIMAL(30, 2)) AS money, CASE WHEN id = 1 THEN double('NaN') ELSE double(id) END AS x, id + 9007199254740990 AS big FROM range(6)"
    )
    got = {r.name: r for r in P.profile_table(df, "t", ["id"]).collect()}
    assert {n: r.coarse_type for n, r in got.items()} == {
        "id": "numeric", "flag": "boolean", "day": "datetime", "list": "text", "money": "numeric", "x": "numeric", "big": "numeric",
    }
    assert (got["day"].stats.min_str, got["day"].stats.max_str) == ("2020-01-01", "2020-01-06")
    assert [t.value for t in got["flag"].stats.top_values] == ["False", "True"]
    assert (got["x"].num_non_null, got["x"].example_values[:2]) == (5, ["0.0", "2.0"])
    assert (got["big"].num_unique, got["money"].num_unique) == (6, 6)
    assert got["list"].example_values[0] == "[0,1]"


def test_empty_typed_table(spark):
    got = {r.name: r for r in P.profile_table(spark.createDataFrame([], "a bigint, b string"), "t", ["a"]).collect()}
    assert (got["a"].num_rows, got["a"].null_fraction, got["b"].example_values) == (0, None, [])


def test_too_many_fields_is_an_error_row(spark, tmp_path):
    folder = write(tmp_path, bad="a,b\n1,2\n1,2,3\n", good="a\n1\n")
    got = {r.dataset_id: r for r in P.minimal_profile(stage_collection(spark, folder)).collect()}
    assert (got["bad"].status, got["bad"].row_count) == ("error", None)
    assert "saw 3" in got["bad"].error
    assert got["good"].status == "ok"


def test_wide_files_are_not_cut(spark, tmp_path):
    wide = ",".join(f"c{i}" for i in range(150))
    folder = write(tmp_path, wide=wide + "\n" + ",".join(str(i) for i in range(150)) + "\n", thin="a\n1\n")
    got = {r.dataset_id: r for r in P.minimal_profile(stage_collection(spark, folder)).collect()}
    assert got["wide"].column_count == 150 and got["thin"].column_count == 1


def test_split_files_keep_their_row_order(spark, tmp_path):
    text = "n,t\n" + "".join(f"{i},row {i} {'x' * 50}\n" for i in range(3000))
    folder = write(tmp_path, long=text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        staged = stage_collection(spark, folder, multi_line=False)
        cells = collection_cells(staged).where("col_idx = 0 AND row_idx IS NOT NULL")
        assert staged.where("row_idx >= 0").count() == 3000
        assert cells.where("row_idx <> bigint(value)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_repeated_and_blank_headers(spark, tmp_path):
    folder = write(tmp_path, d="a,a,,b\n1,2,3,4\n")
    assert P.minimal_profile(stage_collection(spark, folder)).first().columns == ["a", "a.1", "Unnamed: 2", "b"]


def test_paths_and_statuses(spark, tmp_path):
    roots = [tmp_path / "r0", tmp_path / "r1", tmp_path / "nowhere"]
    for r in roots[:2]:
        r.mkdir()
    write(roots[0], x="a\n1\n")
    write(roots[1], x="a\n1\n", y="a\n2\n", blank="\n", empty="")
    listing = list_csv_files(spark, [str(r) for r in roots])
    ids = spark.createDataFrame([("x",), ("y",), ("blank",), ("empty",), ("gone",)], "dataset_id string")
    found = {r.dataset_id: r for r in resolve_csv_paths(ids, listing).collect()}
    assert "/r0/x.csv" in found["x"].path and "/r1/y.csv" in found["y"].path
    assert found["gone"].status == "missing_csv"
    paths = [r.path for r in found.values() if r.path]
    minimal = P.minimal_profile(stage_collection(spark, paths, FILE_STEM))
    got = {r.dataset_id: r.status for r in collection_status(ids, listing, minimal).collect()}
    # A file without a single byte is not listed by Spark, so it counts as missing.
    assert got == {"x": "ok", "y": "ok", "blank": "error", "empty": "missing_csv", "gone": "missing_csv"}


def test_column_choice_limits(spark):
    rows = [
        ("d", 0, "ratio90", 0.0, 90, 100), ("d", 1, "ratio91", 0.0, 91, 100), ("d", 2, "null79", 0.79, 5, 100),
        ("d", 3, "null80", 0.80, 5, 100), ("d", 4, "next", 0.0, 5, 100), ("e", 0, "norows", None, 0, 0),
    ]
    df = spark.createDataFrame(rows, "dataset_id string, col_idx int, name string, null_fraction double, num_unique bigint, num_rows bigint")
    assert {r.name for r in choose_columns(df, 2).collect()} == {"ratio90", "null79", "norows"}


def test_number_of_jobs_does_not_grow_with_datasets(spark, tmp_path):
    def jobs(n):
        folder = tmp_path / str(n)
        folder.mkdir()
        write(folder, **{f"d{i}": f"a,b\n{i},x\n{i + 1},y\n" for i in range(n)})
        group = f"profile-{n}"
        spark.sparkContext.setJobGroup(group, group)
        P.profile_cells(collection_cells(stage_collection(spark, str(folder)))).write.format("noop").mode("overwrite").save()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(40) <= jobs(4) + 3


def test_long_texts_are_counted_by_digest(spark):
    """Distinct counts and top values of long texts, with ties behind a common beginning."""
    long = ["same beginning of forty characters, then " + c * 5_000 for c in "dcba"]
    rows = [(i, t) for i, t in enumerate([*long, long[1], "short", "short", None, long[0][:64], long[0][:65]])]
    df = spark.createDataFrame(rows, "id int, text string")
    values = P.table_values(df, "t")
    sizes = values.select(*[F.max(F.length(c)).alias(c) for c in ("txt", "digest", "head")]).first()
    assert sizes.txt <= P.LONG and sizes.digest == 64 and sizes.head == P.HEAD
    text = next(r for r in P.profile_table(df, "t", ["id"], top_k=4).collect() if r.name == "text")
    assert (text.num_non_null, text.num_unique) == (9, 7)
    # Two values twice, then the smallest of those that occur once.
    assert [(v.value, v["count"]) for v in text.stats.top_values] == [(long[1], 2), ("short", 2), *((t, 1) for t in sorted([long[0][:64], long[0][:65], long[0], long[2], long[3]])[:2])]
    cells = df.select(F.lit("t").alias("dataset_id"), F.col("id").cast("bigint").alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("text").alias("col_name"), F.col("text").alias("value"))
    profile = P.profile_cells(cells, top_k=4).first()
    assert profile.num_unique == 7 and profile.stats.top_values == text.stats.top_values


def gzipped(text):
    import gzip

    return gzip.compress(text.encode())


def test_damaged_files(spark, tmp_path):
    rng = __import__("random").Random(1)
    body = "a,b\n" + "".join(f"{i},{rng.random()}\n" for i in range(5_000))
    whole = gzipped(body)
    flipped = bytearray(whole)
    flipped[len(whole) // 2] ^= 1
    trailer = bytearray(whole)
    trailer[-6] ^= 1
    files = {"whole": whole, "cut": whole[: len(whole) // 2], "cut_trailer": whole[:-1], "flipped": bytes(flipped), "trailer": bytes(trailer), "garbage": whole + b"x", "no_gzip": body.encode()}
    files["members"] = gzipped(body[:9_000]) + gzipped(body[9_000:])
    files["cut_member"] = gzipped(body[:9_000]) + gzipped(body[9_000:])[:-9]
    for name, data in files.items():
        (tmp_path / f"{name}.csv.gz").write_bytes(data)
    (tmp_path / "bz.csv.bz2").write_bytes(__import__("bz2").compress(body.encode()))
    (tmp_path / "bzcut.csv.bz2").write_bytes(__import__("bz2").compress(body.encode())[:-20])
    (tmp_path / "plain.csv").write_text(body)
    pattern = r"([^/]+?)\.csv(?:\.gz|\.bz2)?$"
    good = {"whole", "members", "bz", "plain"}
    staged = collection.stage_collection(spark, str(tmp_path), pattern)
    got = {r.dataset_id: (r.status, r.row_count, r.error) for r in P.minimal_profile(staged).collect()}
    want = {n: ("ok", 5_000, None) if n in good else ("error", None, collection.DAMAGED) for n in [*files, "bz", "bzcut", "plain"]}
    assert got == want
    assert {r.dataset_id for r in collection.collection_cells(staged).select("dataset_id").distinct().collect()} == good
    # Files that are too large to be held are read one by one.
    damaged = collection.damaged_files(spark, str(tmp_path), checked_bytes=1)
    names = {r.path.rsplit("/", 1)[1].split(".")[0] for r in damaged.collect()}
    assert names >= {"cut", "flipped", "trailer", "cut_member"} and not names & good


def test_only_wide_files_are_read_again(spark, tmp_path, monkeypatch):
    (tmp_path / "n a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "w[1].csv").write_text(",".join(f"c{i}" for i in range(100)) + "\n" + ",".join("x" * 100) + "\n")
    read = []
    inner = collection._read_rows

    def noted(spark, paths, *more):
        read.append(paths)
        return inner(spark, paths, *more)

    monkeypatch.setattr(collection, "_read_rows", noted)
    staged = collection.stage_collection(spark, str(tmp_path))
    got = {r.dataset_id: (r.status, r.column_count, r.row_count) for r in P.minimal_profile(staged).collect()}
    assert sorted(v[1:] for v in got.values()) == [(2, 1), (100, 1)]
    assert len(read) == 2 and len(read[1]) == 1 and "w" in read[1][0]
