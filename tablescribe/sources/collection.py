"""A whole collection of differently shaped CSV files as one DataFrame.

One CSV scan reads every file with an all-text schema. Rows are numbered inside their file and meet the file's header
row, so that thousands of small tables are profiled by one plan instead of one job each.
"""

from __future__ import annotations

import bz2
import csv
import io
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stores
from ..session import materialize, qualified

# The cell texts that stand for a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The file name without its extension names the dataset.
FILE_STEM = r"([^/]+?)(?:\.csv)?$"
DAMAGED = "the compressed file is damaged"
# Compressed files up to this size are checked by tasks that hold one of them at a time, larger ones by a strict read each.
CHECKED_BYTES = 256 << 20
# Files that are named one by one to a reader; more of them are found by reading all.
LISTED_FILES = 10_000
# Folders are listed by so many tasks a core; Spark's own number, a task for each of up to 10,000, costs more than the listing.
LISTING_TASKS = 8
_LISTING_CONF = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
# The reader's buffer; its own default of 2 MB is filled anew for every file.
BUFFER_CHARS = 65_536
# Fields behind those that are read, which also tell that a record has more. With the default width they make more columns than
# Spark compiles into one method, which would be too long for the JVM's compiler.
GUARDS = 40
# Plain files up to so many bytes are parsed whole by a task; what is not plain, or longer, is left to Spark's reader.
PLAIN_BYTES = 8 << 20
# Bytes of files that a task is given, and records that leave it together.
PARSED_BYTES = 32 << 20
_BATCH_RECORDS = 4_000
# Fewer files or folders than these are no task of their own, unless by their bytes.
FILES_A_TASK = 16
# Records of more fields are not parsed by the tasks.
_PLAIN_FIELDS = 10_000
# Paths that readers write as they are, of files that no codec unpacks; names that readers do not hide.
_PLAIN_PATH = re.compile(r"(?:file|hdfs|s3[an]?):[\w./:=-]*/[A-Za-z0-9=-](?:[\w=-]*|[\w.=-]*\.(?:csv|txt|tsv))", re.ASCII)
# What a reader takes for a pattern in a path.
_GLOB = r"[*?\[\]{}\\]"
_FIELD = r'(?:"(?:[^"]++|"")*+"|[^",\n]*+)'
_PLAIN_TEXT = re.compile(rf"{_FIELD}(?:[,\n]{_FIELD})*+")
# Of records that a task has parsed the header is known, and ``at`` is their number in the file.
_ROWS = "path string, block long, at long, full boolean, fields array<string>, header array<string>"
_FILES = "path string, length long"
_LISTING = "dataset_id string, root_priority int, path string"


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Readers that are made in this block list their folders by a number of tasks that follows the cores."""
    before = spark.conf.get(_LISTING_CONF)
    spark.conf.set(_LISTING_CONF, min(int(before), LISTING_TASKS * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(_LISTING_CONF, before)


def _spark_rows(spark: SparkSession, paths: list[str], width: int, multi_line: bool, recursive: bool) -> DataFrame:
    """The records as Spark's reader gives them."""
    names = [f"_c{i}" for i in range(width + GUARDS)]
    # The reader looks for each missing field of a record in a list of all, unless it is to skip columns: so there is one that is not read.
    with _few_listing_tasks(spark):
        rows = (
            spark.read.schema(", ".join(f"{n} string" for n in [*names, "_rest"]))
            .option("header", False)
            .option("multiLine", multi_line)
            .option("escape", '"')
            .option("recursiveFileLookup", recursive)
            .option("ignoreCorruptFiles", True)
            .option("maxColumns", max(20_480, width + GUARDS + 1))
            .option("columnPruning", True)
            .option("inputBufferSize", BUFFER_CHARS)
            .csv(paths)
        )
    fields = F.array(*names[:width])
    last = F.array_max(F.transform(fields, lambda x, i: F.when(x.isNotNull(), i + 1)))
    return rows.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.exists(F.array(*names[width - 1 :]), lambda x: x.isNotNull()).alias("full"),
        F.slice(fields, 1, F.coalesce(last, F.lit(0))).alias("fields"),
        F.lit(None).cast("array<string>").alias("header"),
    )


def _hidden(name: str) -> bool:
    """Whether readers pass a file or folder of this name over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _tasks(spark: SparkSession, n: int, size: int = 0) -> int:
    """Tasks for ``n`` small files or folders of ``size`` bytes in all."""
    return max(1, min(n // FILES_A_TASK, LISTING_TASKS * spark.sparkContext.defaultParallelism), -(-size // PARSED_BYTES))


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is in each folder: ``path, length, folder``."""
    from pyarrow import fs

    for batch in batches:
        for uri in batch.column("path").to_pylist():
            system, path = stores.store(uri)
            found = [f for f in system.get_file_info(fs.FileSelector(path)) if not _hidden(f.base_name)]
            folder = [f.type == fs.FileType.Directory for f in found]
            # Files without a single byte are not listed.
            kept = [(f"{uri.rstrip('/')}/{f.base_name}", None if d else f.size, d) for f, d in zip(found, folder) if d or f.size]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_()))], names=["path", "length", "folder"])


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """``path, length`` of all files in folders and the folders in them, listed by tasks; None where only Spark can list them.

    Spark's own listing keeps an entry for every file at the driver.
    """
    if any(re.search(_GLOB, p) for p in paths) or len(paths) > LISTED_FILES:
        return None
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    roots = sorted({qualified(spark, p) for p in paths})
    for root in roots:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        if not re.match(r"(?:file|hdfs|s3[an]?):", root) or not path.getFileSystem(conf).exists(path) or not path.getFileSystem(conf).getFileStatus(path).isDirectory():
            return None
    folders, levels = spark.createDataFrame([(r,) for r in roots], "path string"), []
    while n := folders.count():
        level = materialize(folders.repartition(_tasks(spark, n), "path").mapInArrow(_list_folders, f"{_FILES}, folder boolean"), "listed")
        levels.append(level.where(~F.col("folder")).select("path", "length"))
        folders = level.where("folder").select("path")
    return reduce(DataFrame.unionByName, levels, spark.createDataFrame([], _FILES))


def _distinct_texts(names: list[str | None]) -> list[str]:
    """The same as :func:`_distinct_names`."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        name = f"Unnamed: {i}" if name is None else name
        n = seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def _records(data: bytes) -> list[list[str | None]] | None:
    """The records of a plain file, ends without a value cut off; None where it takes Spark's reader to say what they are.

    Plain are UTF-8 texts with line feeds only, in which quotes enclose whole fields or are doubled within them.
    """
    if b"\r" in data or b"\0" in data or data.startswith(b"\xef\xbb\xbf"):
        return None
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    if '"' not in text:
        rows = [line.split(",") for line in text.split("\n") if line]
    elif not _PLAIN_TEXT.fullmatch(text):
        return None
    else:
        csv.field_size_limit(PLAIN_BYTES)
        rows = [row for row in csv.reader(io.StringIO(text, newline=""), strict=True) if row]
    out = []
    for row in rows:
        if len(row) > _PLAIN_FIELDS:
            return None
        row = [v or None for v in row]
        while row and row[-1] is None:
            row.pop()
        out.append(row)
    return out


def _parse_files(width: int):
    """Reads files by ``path``: the records of plain ones, and of others a row that has a path only."""
    from pyarrow import fs

    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("full", pa.bool_()), ("fields", pa.list_(pa.string())), ("header", pa.list_(pa.string()))])

    def read(uri: str) -> bytes | None:
        if not _PLAIN_PATH.fullmatch(uri):
            return None
        try:
            system, path = stores.store(uri)
            with system.open_input_stream(path, compression=None) as f:
                data = f.read(PLAIN_BYTES + 1)
        except OSError:
            return None
        return data if len(data) <= PLAIN_BYTES else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)

        for batch in batches:
            for uri in batch.column("path").to_pylist():
                data = read(uri)
                rows = None if data is None else _records(data)
                if rows is None:
                    held.append((uri, None, None, None, None, None))
                    continue
                header = _distinct_texts(rows[0][:width]) if rows else None
                for at, row in enumerate(rows):
                    full = len(row) >= width and any(v is not None for v in row[width - 1 :])
                    if len(row) > width:
                        row = row[:width]
                        while row and row[-1] is None:
                            row.pop()
                    held.append((uri, 0, at, full, row, header))
                    if len(held) >= _BATCH_RECORDS:
                        yield out()
                        held = []
        if held:
            yield out()

    return parse


def _read_rows(spark: SparkSession, paths: list[str], width: int, multi_line: bool, recursive: bool, files: DataFrame | None = None) -> DataFrame:
    """Written records as arrays of up to ``width`` texts, ends without a value cut off, with their place in the file.

    ``full`` marks records that fill the ``width``, or have values in one of the next fields. A file that cannot be read ends where the damage is.
    ``files`` are those in ``paths``, where they have been listed. Files are parsed by tasks that take many of them each; those that
    are not plain (:func:`_records`) are left to Spark's reader, which has a task's time to lose for each of them.
    """
    if not multi_line:
        return materialize(_spark_rows(spark, paths, width, multi_line, recursive), "csv-rows")
    if files is None and recursive:
        files = list_files(spark, paths)
        if files is None:
            return materialize(_spark_rows(spark, paths, width, multi_line, recursive), "csv-rows")
    odd: list[str] = []
    if files is None:
        # Files by their names, as a reader takes them.
        odd = [p for p in paths if re.search(_GLOB, p)]
        plain = [p if ":" in p else qualified(spark, p) for p in paths if not re.search(_GLOB, p)]
        files, n, size = spark.createDataFrame([(p,) for p in plain], "path string"), len(plain), 0
    else:
        n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    parsed = materialize(files.select("path").repartition(_tasks(spark, n, size), "path").mapInArrow(_parse_files(width), _ROWS), "csv-rows")
    rows = parsed.where(F.col("at").isNotNull())
    left = parsed.where(F.col("at").isNull()).select("path")
    listed = _listed(left, encoded=False)
    if listed is None:
        # Spark gives paths as URIs.
        path = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
        rest = _spark_rows(spark, paths, width, multi_line, recursive)
        return rows.unionByName(materialize(rest.join(left.select(F.col("path").alias("left")), path == F.col("left"), "left_semi"), "csv-rows"))
    listed += odd
    return rows.unionByName(materialize(_spark_rows(spark, listed, width, multi_line, False), "csv-rows")) if listed else rows


def _whole_gzip(data: memoryview) -> bool:
    """Whether ``data`` is one or more gzip members, each with the checksum and length that its trailer gives."""
    at = 0
    while at < len(data):
        member = zlib.decompressobj(wbits=31)
        try:
            while not member.eof:
                if at == len(data):
                    return False
                # The decompressor compares the trailer itself; bytes behind the member come back.
                step = data[at : at + (1 << 20)]
                member.decompress(step)
                at += len(step) - len(member.unused_data)
        except zlib.error:
            return False
    return at > 0


def _whole_bzip2(data: memoryview) -> bool:
    """The same for bzip2 streams."""
    at = 0
    while at < len(data):
        stream = bz2.BZ2Decompressor()
        try:
            while not stream.eof:
                if at == len(data):
                    return False
                step = data[at : at + (1 << 20)]
                stream.decompress(step)
                at += len(step) - len(stream.unused_data)
        except (OSError, EOFError):
            return False
    return at > 0


_CHECKS = {".gz": _whole_gzip, ".bz2": _whole_bzip2}


def damaged_files(spark: SparkSession, paths: str | list[str], recursive: bool = True, checked_bytes: int = CHECKED_BYTES, files: DataFrame | None = None) -> DataFrame:
    """``path`` of the compressed files (gzip, bzip2) that end early or whose content is not what their checksums say.

    Files of several members, one behind the other, are whole if every member is; files of zero bytes count as missing here as
    elsewhere. What is read is only compressed files; those of up to ``checked_bytes`` in one pass, a task holding one at a time, each larger one by a
    read that fails where the file does. ``files`` are those in ``paths``, where they have been listed.
    """
    paths = [paths] if isinstance(paths, str) else paths
    listed = None if files is None else _listed(files.where(F.regexp_like("path", F.lit(rf"({'|'.join(map(re.escape, _CHECKS))})$"))), encoded=False)
    if listed == []:
        return spark.createDataFrame([], "path string")
    with _few_listing_tasks(spark):
        files = spark.read.format("binaryFile").options(pathGlobFilter=f"*{{{','.join(_CHECKS)}}}", recursiveFileLookup=recursive and listed is None).load(paths if listed is None else listed)
    large = [r["path"] for r in files.where(F.col("length") > checked_bytes).select("path").collect()]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                whole = _CHECKS[path[path.rindex(".") :]](memoryview(content.as_buffer()))
                yield pa.RecordBatch.from_arrays([pa.array([] if whole else [path], pa.string())], names=["path"])

    damaged = files.where(F.col("length") <= checked_bytes).select("path", "content").mapInArrow(check, "path string")
    broken = [(path,) for path in large if not _reads(spark, path)]
    return damaged.unionByName(spark.createDataFrame(broken, "path string")) if broken else damaged


def _reads(spark: SparkSession, path: str) -> bool:
    """Whether a file can be read to its end."""
    try:
        spark.read.option("ignoreCorruptFiles", False).text(path).agg(F.sum(F.length("value"))).collect()
    except (PySparkException, Py4JJavaError):
        return False
    return True


def _distinct_names(names: Column) -> Column:
    """Column names as a reader gives them: blanks become ``Unnamed: i``, repeats get ``.1``, ``.2``."""
    filled = F.transform(names, lambda x, i: F.coalesce(x, F.concat(F.lit("Unnamed: "), i.cast("string"))))

    def numbered(x: Column, i: Column) -> Column:
        seen = F.size(F.filter(F.slice(filled, 1, i), lambda y: y == x))
        return F.when(seen == 0, x).otherwise(F.concat(x, F.lit("."), seen.cast("string")))

    return F.transform(filled, numbered)


def stage_collection(
    spark: SparkSession,
    paths: str | list[str],
    dataset_pattern: str = FILE_STEM,
    multi_line: bool = True,
    width: int = 64,
    only: DataFrame | None = None,
    recursive: bool = True,
) -> DataFrame:
    """Rows of all CSV files: ``dataset_id, path, row_idx, header, fields, n_fields, problem``.

    ``row_idx`` is -1 for the header row, whose ``fields`` are the column names. ``n_fields`` exceeds the header's
    size in a row that has too many fields. ``dataset_pattern`` extracts the dataset id from a file's path, and ``only``
    (``path``) restricts the files. ``problem`` tells why a file is no table: its id is that of another file too, its path
    has no id, or it is a damaged compressed file, of which the rows before the damage are all there is; a file without an
    id is its own dataset, named by its path.

    ``multi_line=True`` allows line breaks inside quotes, at the price that one file is read by one task; for very
    long line-delimited files use ``multi_line=False``, which splits them. The parsed rows are written out once, because
    positions inside a file must come from one scan. Records with more than ``width`` fields are never cut: the files
    that have one are read again eight times as wide. Of a damaged file only the header decides: what is decompressed of it may
    hold records of any number of fields, which say as much by the first ones beyond the header.
    """
    paths = [paths] if isinstance(paths, str) else paths
    listed = list_files(spark, paths) if recursive and only is None else only
    damaged = materialize(damaged_files(spark, paths, recursive, files=listed), "damaged").distinct().withColumn("damaged", F.lit(True))
    damaged = damaged if only is None else damaged.join(only.select("path"), "path", "left_semi")
    everything = _read_wide(spark, paths, width + 1, multi_line, recursive, only, damaged.select("path"), None if only is not None else listed)
    # Records that tasks have parsed know their place in the file; it takes all records of a file to place those of Spark's reader.
    parsed = everything.where(F.col("header").isNotNull())
    raw = everything.where(F.col("header").isNull()).drop("header")
    in_order = Window.partitionBy("path").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    # One row per block of a file; the window runs over a file's blocks, not over its rows.
    blocks = (
        raw.groupBy("path", "block")
        .agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"), F.min_by("fields", "at").alias("head"))
        .withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("head", F.first("head").over(in_order))
        .withColumn("n_head", F.array_max(F.transform("head", lambda x, i: F.when(x.isNotNull(), i + 1))))
        .withColumn("header", _distinct_names(F.slice("head", 1, F.coalesce("n_head", F.lit(0)))))
        .select("path", "block", "start", "skip", "header")
    )
    n_header = F.size("header")
    overflow = F.slice("fields", n_header + 1, F.greatest(F.size("fields") - n_header, F.lit(0)))
    last = F.array_max(F.transform(overflow, lambda x, i: F.when(x.isNotNull(), n_header + i + 1)))
    row_idx = F.col("skip") + F.col("at") - F.col("start") - 1
    missing = F.array_repeat(F.lit(None).cast("string"), F.greatest(n_header - F.size("fields"), F.lit(0)))
    cells = F.concat(F.slice("fields", 1, n_header), missing)
    # Of some damaged files no row is left.
    heads = parsed.where(F.col("at") == 0).select("path")
    files = heads.unionByName(blocks.select("path").distinct()).join(damaged, "path", "full").withColumn("id", F.regexp_extract("path", dataset_pattern, 1))
    shared = files.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col("id") == ""))
    problem = F.when(F.col("id") == "", "the path has no dataset id").when(F.col("n") > 1, "several files have this dataset id").when(F.col("damaged"), DAMAGED)
    # Few files have a problem: they are written, so that it shows that they are few and no row has to meet them in another task.
    odd = materialize(files.join(shared, "id", "left").select("path", problem.alias("problem")).where(F.col("problem").isNotNull()), "problems")
    found = F.regexp_extract("path", dataset_pattern, 1)
    start = {"start": F.lit(0).cast("bigint"), "skip": F.lit(0).cast("bigint")}
    placed = raw.join(blocks, ["path", "block"]).unionByName(parsed.withColumns(start))
    lost = damaged.join(blocks.select("path"), "path", "left_anti")
    empty = lost.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "path" else F.col("path") for f in placed.schema.fields])
    return placed.unionByName(empty.select(*placed.columns)).join(odd, "path", "left").select(
        F.when(found == "", F.col("path")).otherwise(found).alias("dataset_id"),
        "path",
        row_idx.alias("row_idx"),
        "header",
        F.when(row_idx < 0, F.col("header")).otherwise(cells).alias("fields"),
        F.coalesce(last, n_header).alias("n_fields"),
        "problem",
    )


def _listed(only: DataFrame, most: int = LISTED_FILES, encoded: bool = True) -> list[str] | None:
    """The paths of ``only``, which may be ``encoded`` as URIs, as a reader takes them; None if there are too many to list."""
    found = [r["path"] for r in only.select("path").distinct().limit(most + 1).collect()]
    return None if len(found) > most else [re.sub(r"([*?\[\]{}\\])", r"\\\1", unquote(p) if encoded else p) for p in found]


def _read_wide(spark: SparkSession, paths: list[str], width: int, multi_line: bool, recursive: bool, only: DataFrame | None, damaged: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Written rows of the files, each as wide as it needs, ``damaged`` ones as wide as their headers need.

    Of ``only`` some files no others are opened, if they can be listed. ``files`` are those in ``paths``, where they have been listed.
    """
    listed = None if only is None else _listed(only)
    if listed == []:
        return materialize(spark.createDataFrame([], _ROWS), "csv-rows")
    if only is None or listed is not None:
        raw = _read_rows(spark, paths if listed is None else listed, width, multi_line, recursive and listed is None, files)
    else:
        found = list_files(spark, paths) if recursive and multi_line else None
        some = None if found is None else found.join(only.select("path").distinct(), "path", "left_semi")
        raw = _read_rows(spark, paths, width, multi_line, recursive, some)
        raw = raw if some is not None else raw.join(only.select("path"), "path", "left_semi")
    wide = raw.where("full").select("path").distinct().join(damaged, "path", "left_anti")
    heads = raw.join(damaged, "path", "left_semi").groupBy("path").agg(F.min_by("full", F.struct("block", "at")).alias("full"))
    wide = wide.unionByName(heads.where("full").select("path"))
    if wide.isEmpty():
        return raw
    wider = _read_wide(spark, paths, (width - 1) * 8 + 1, multi_line, recursive, wide, damaged)
    return raw.join(wide, "path", "left_anti").unionByName(wider)


def collection_cells(staged: DataFrame, na_tokens: list[str] = NA_TOKENS) -> DataFrame:
    """The long form ``dataset_id, row_idx, col_idx, col_name, value`` with missing values as NULL.

    Every column also has one row with NULL ``row_idx`` and ``value`` from the header, so that columns of tables
    without rows are kept. Files with a problem have no cells.
    """
    cells = staged.where(F.col("problem").isNull()).select(
        "dataset_id",
        F.when(F.col("row_idx") >= 0, F.col("row_idx")).alias("row_idx"),
        F.posexplode(F.arrays_zip(F.col("header").alias("name"), F.col("fields").alias("value"))).alias("col_idx", "cell"),
    )
    value = F.col("cell.value")
    return cells.select(
        "dataset_id",
        "row_idx",
        "col_idx",
        F.col("cell.name").alias("col_name"),
        F.when(F.col("row_idx").isNotNull() & ~value.isin(na_tokens), value).alias("value"),
    )


def table_cells(df: DataFrame, dataset_id: str, order_by: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of a typed table in the long form (``n`` is a prompt's sample size, so few rows)."""
    from ..operators.profile import as_text

    head = df.orderBy(*order_by).limit(n)
    numbered = head.withColumn("__row", F.row_number().over(Window.orderBy(*order_by)) - 1)
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("col_idx"), F.lit(f.name).alias("col_name"), as_text(f).alias("value"))
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return numbered.select(
        F.lit(dataset_id).alias("dataset_id"), F.col("__row").cast("bigint").alias("row_idx"), F.explode(cells).alias("c")
    ).select("dataset_id", "row_idx", "c.*")


def list_csv_files(spark: SparkSession, roots: list[str], dataset_pattern: str = FILE_STEM, recursive: bool = False) -> DataFrame:
    """``dataset_id, root_priority, path`` of the CSV files in each root, roots in order of preference."""
    listing = spark.createDataFrame([], _LISTING)
    for priority, root in enumerate(roots):
        files = list_files(spark, [root]) if recursive else None
        if files is not None:
            dataset = F.regexp_extract("path", dataset_pattern, 1).alias("dataset_id")
            listing = listing.unionByName(files.where(F.endswith("path", F.lit(".csv"))).select(dataset, F.lit(priority).alias("root_priority"), "path"))
            continue
        try:
            with _few_listing_tasks(spark):
                files = spark.read.format("binaryFile").options(pathGlobFilter="*.csv", recursiveFileLookup=recursive).load(root)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found = files.select(
            F.regexp_extract("path", dataset_pattern, 1).alias("dataset_id"), F.lit(priority).alias("root_priority"), "path"
        )
        listing = listing.unionByName(found)
    return listing


def resolve_csv_paths(ids: DataFrame, listing: DataFrame) -> DataFrame:
    """Each id with the path from its most preferred root; ``missing_csv`` where no root has the file.

    Of several files of one id in that root the first path is given, and :func:`collection_status` reports the id.
    """
    best = listing.groupBy("dataset_id").agg(F.min_by("path", F.struct("root_priority", "path")).alias("path"))
    return ids.join(best, "dataset_id", "left").withColumn(
        "status", F.when(F.col("path").isNull(), "missing_csv").otherwise("ok")
    )


def collection_status(ids: DataFrame, listing: DataFrame, minimal: DataFrame) -> DataFrame:
    """Minimal profiles for every wanted id, with ``missing_csv`` and unreadable files as rows instead of failures."""
    resolved = resolve_csv_paths(ids, listing)
    first = listing.groupBy("dataset_id").agg(F.min("root_priority").alias("root_priority"))
    clash = listing.join(first, ["dataset_id", "root_priority"]).groupBy("dataset_id").count().where("count > 1").select("dataset_id", F.lit(True).alias("clash"))
    resolved = resolved.join(clash, "dataset_id", "left")
    joined = resolved.withColumnRenamed("status", "found").join(minimal, "dataset_id", "left")
    missing = F.col("found") == "missing_csv"
    clash = F.coalesce("clash", F.lit(False))
    empty = F.col("status").isNull() | clash
    error = (
        F.when(missing, F.concat(F.lit("no CSV file for "), F.col("dataset_id")))
        .when(clash, F.lit("several files have this dataset id"))
        .when(empty, F.lit("the file is empty or cannot be read"))
        .otherwise(F.col("error"))
    )
    return joined.select(
        "dataset_id",
        F.when(missing, "missing_csv").when(empty, "error").otherwise(F.col("status")).alias("status"),
        *[F.when(~empty, F.col(c)).alias(c) for c in ("row_count", "column_count", "columns")],
        error.alias("error"),
    )
