"""Corpus sources.

A corpus is a DataFrame ``(repo, path, content)`` with one row per file.
``path`` is relative to the repository root and uses ``/``.  A folder tree is
listed and read in tasks; all else is a narrow projection/filter.  Eligibility
is decided from the path alone, before the content column is touched, so
Parquet scans prune and push the path filters down.
"""

from __future__ import annotations

import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import EXCLUDED_PARTS, EXTENSIONS
from ..functions.text import universal_newlines
from ..session import checkpoint_dir
from .bucketed import read_bucketed, write_bucketed

CORPUS_COLUMNS = ["repo", "path", "content"]


#: Folders that one task lists before it hands the rest of its folders on, and bytes of files that one task reads.
TASK_FOLDERS, TASK_BYTES = 1000, 64 << 20
LISTED = "path string, folder boolean, size long"
#: Hadoop's schemes by the name that Arrow's file systems know.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfs"}


def _root_uri(spark: SparkSession, root: str) -> str:
    """The root as an encoded URI, qualified by Spark's default file system."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    path = hadoop.Path(root)
    scheme = path.toUri().getScheme() or hadoop.FileSystem.getDefaultUri(conf).getScheme()
    if scheme not in SCHEMES:
        raise ValueError(f"folders cannot be listed in tasks by scheme {scheme!r}: store the corpus as a table")
    uri = path.getFileSystem(conf).makeQualified(path).toUri()
    return f"{SCHEMES[scheme]}://{uri.getRawAuthority() or ''}{uri.getRawPath()}"


def _listing(uri: str, folders: int):
    """Lists folders, depth first; one of which a task does not get to is handed on."""
    excluded_names, extensions = frozenset(EXCLUDED_PARTS), frozenset(EXTENSIONS)

    def walk(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(uri)
        left = folders
        for batch in batches:
            todo = batch.column(0).to_pylist()
            while todo and left:
                left -= 1
                at, rows = todo.pop(), []
                for info in system.get_file_info(fs.FileSelector(f"{top}/{at}".rstrip("/") or "/")):
                    name = info.base_name
                    place = f"{at}/{name}" if at else name
                    if info.type == fs.FileType.Directory:
                        if name not in excluded_names:
                            todo.append(place)
                    elif "." in name[1:] and "." + name.rsplit(".", 1)[1].lower() in extensions and name not in excluded_names:
                        rows.append((place, info.size))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows]), pa.array([False] * len(rows)), pa.array([r[1] for r in rows], pa.int64())],
                        names=["path", "folder", "size"])
            if todo:
                yield pa.RecordBatch.from_arrays([pa.array(todo), pa.array([True] * len(todo)), pa.nulls(len(todo), pa.int64())],
                                                 names=["path", "folder", "size"])

    return walk


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (below ``root``) and ``size`` of every file that is eligible by
    its name, hidden names included.

    The folders still to list are a table.  Each round lists them in tasks, a
    task walking down until it has listed ``TASK_FOLDERS``; what it did not get
    to is the next round's table.  No name passes through the driver.  Excluded
    folders are not entered and other extensions not listed, so neither is ever
    read.  Rounds are stored below ``spark.checkpoint.dir``; a folder that
    cannot be listed fails the job.
    """
    uri, folders = _root_uri(spark, root), TASK_FOLDERS
    out = f"{checkpoint_dir(spark).rstrip('/')}/listing-{uuid.uuid4().hex}"
    todo, waiting, rounds = spark.createDataFrame([("",)], "path string"), 1, []
    while waiting:
        tasks = max(1, min(waiting, max(spark.sparkContext.defaultParallelism, 4 * waiting // folders)))
        listed = todo.repartition(tasks).mapInArrow(_listing(uri, folders), LISTED)
        listed.write.parquet(f"{out}/{len(rounds)}")
        rounds.append(spark.read.schema(LISTED).parquet(f"{out}/{len(rounds)}"))
        todo = rounds[-1].where("folder").select("path")
        waiting = todo.count()
    return reduce(DataFrame.unionByName, rounds).where("not folder").select("path", "size")


def read_folder(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame:
    """S1 for a folder tree: every file with a supported extension outside the
    excluded folders, hidden names included; ``path`` is relative to ``root``
    (which may be relative, or a URI).  ``repo`` defaults to the folder name.

    Names are listed and contents read in tasks, through Arrow's file systems
    (see ``SCHEMES``; another scheme is an error before any work).  A file that
    is gone when it is read fails the job rather than being left out.
    """
    uri = _root_uri(spark, root)
    files = list_files(spark, root)
    total = files.agg(F.sum("size")).first()[0] or 0
    raw = files.repartition(max(spark.sparkContext.defaultParallelism, total // TASK_BYTES + 1), "path").select("path") \
        .mapInArrow(_contents(uri), "path string, content binary")
    return raw.select(
        F.lit(repo or unquote(uri).rstrip("/").rsplit("/", 1)[-1]).alias("repo"), "path",
        # Bytes → text with U+FFFD for invalid sequences
        F.expr("make_valid_utf8(cast(content as string))").alias("content"),
    )


def _contents(uri: str):
    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{top.rstrip('/')}/{path}", compression=None) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())],
                                                     names=["path", "content"])

    return read


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """S1 for a stored corpus: Parquet ``(repo, path, content)``, keeping the
    ``lang`` partition column when the table was written by
    :func:`write_corpus` (so language filters prune directories)."""
    df = spark.read.parquet(path)
    cols = CORPUS_COLUMNS + (["lang"] if "lang" in df.columns else [])
    return df.select(*cols)


def write_corpus(corpus: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store a corpus partitioned by language (``lang=python/``, ``lang=js/``,
    ...; unsupported files under the default partition).  Every extractor
    branch then reads only its own language's files.

    ``partitions`` buckets it by ``(repo, path)`` as well: read with
    :func:`read_bucketed_corpus`, its texts are never shuffled again."""
    df = corpus.select(*CORPUS_COLUMNS, language(F.col("path")).alias("lang"))
    if partitions:
        write_bucketed(df, path, ["repo", "path"], partitions, ["lang"])
    else:
        df.write.mode("overwrite").partitionBy("lang").parquet(path)


def read_bucketed_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus stored by :func:`write_corpus` in buckets."""
    return read_bucketed(spark, path).select(*CORPUS_COLUMNS, "lang")


def extension(path: Column) -> Column:
    """Lower-cased suffix of the base name; a dot-file such as ``.py`` has
    none (S2/Q24)."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^.+(\.[^./]*)$", 1))


def language(path: Column) -> Column:
    """Extension → language code, NULL when unsupported."""
    m = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return m[extension(path)]


def excluded(path: Column) -> Column:
    """S3: any path part equal to an excluded name (exact match, Q23)."""
    parts = F.split(path, "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(p) for p in EXCLUDED_PARTS]))


def folder_of(path: Column) -> Column:
    """Parent folder, ``.`` at the root."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit("")),
                      F.lit("."))


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def classify(corpus: DataFrame) -> DataFrame:
    """Every corpus row with its language and eligibility reason (no content)."""
    lang = F.col("lang") if "lang" in corpus.columns else language(F.col("path"))
    return corpus.select(
        "repo", "path",
        lang.alias("lang"),
        F.when(lang.isNull(), F.lit("unsupported_extension"))
        .when(excluded(F.col("path")), F.lit("excluded_folder"))
        .alias("skip_reason"),
    )


def eligible_files(corpus: DataFrame) -> DataFrame:
    """Eligible files with folder, name, language and decoded text.

    The path predicates come first so that Catalyst evaluates them before
    the (large) content column is materialised.
    """
    # a corpus written by write_corpus carries ``lang`` as a partition
    # column: the language filter then prunes whole directories
    lang = F.col("lang") if "lang" in corpus.columns else language(F.col("path"))
    return (
        corpus.where(lang.isNotNull() & ~excluded(F.col("path")))
        .select(
            "repo", "path",
            folder_of(F.col("path")).alias("folder"),
            name_of(F.col("path")).alias("name"),
            lang.alias("lang"),
            universal_newlines(F.col("content")).alias("text"),
        )
    )
