"""File sources (A1-A13): route, sniff, scan and parse log files into ``events``.

One Spark scan per format covers every file of that format; the frames are
bag-unioned.  Only the given file *names* (and, for sniffing, one first line per path)
ever reach the driver.
"""

from __future__ import annotations

import heapq
import os
import posixpath
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..operators import parse as P
from ..schema import EVENT_COLUMNS
from .json_documents import json_records


# --------------------------------------------------------------------------
# Routing by file name
# --------------------------------------------------------------------------
NAMED_FORMATS = ("apache", "nginx")


def route_format(path: str) -> str | None:
    """Format for a path: a base name that starts with a format's name, else the longest known suffix."""
    name = os.fspath(path).lower()
    leaf = posixpath.basename(name)
    suffix = max(filter(name.endswith, K.EXTENSION_MAP), key=len, default=None)
    return next(filter(leaf.startswith, NAMED_FORMATS), K.EXTENSION_MAP.get(suffix))


def route_format_col(path: Column) -> Column:
    """A7 as a column expression (for ``_metadata.file_path`` or any path column)."""
    p = F.lower(path)
    base = F.regexp_extract(p, r"([^/]*)$", 1)
    out = F.when(base.startswith("apache"), F.lit("apache")).when(base.startswith("nginx"), F.lit("nginx"))
    for ext, name in sorted(K.EXTENSION_MAP.items(), key=lambda kv: len(kv[0]), reverse=True):
        out = out.when(p.endswith(ext), F.lit(name))
    return out


# --------------------------------------------------------------------------
# Sniffing from the first non-blank line
# --------------------------------------------------------------------------
def sniff_format_col(first: Column) -> Column:
    """Format guessed from a file's first non-blank line, or null."""
    f = F.coalesce(first, F.lit(""))
    return (F.when(f == "", F.lit(None).cast("string"))
             .when(F.ltrim(f).startswith("{"),
                   F.when(f.contains('"EventID"') | f.contains('"event_id"'), F.lit("windows_json")).otherwise(F.lit("json")))
             .when(f.contains("sshd[") & (f.contains("Failed password") | f.contains("Accepted") | f.contains("Invalid user")),
                   F.lit("linux_auth"))
             .when(f.contains(" - - [") & (f.contains('"GET ') | f.contains('"POST ')), F.lit("nginx")))


def first_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file, first)``: first non-blank line per file (one row per file)."""
    df = spark.read.text(paths).select("value", _file_key().alias("file"),
                                       F.col("_metadata.file_block_start").alias("_blk"),
                                       F.monotonically_increasing_id().alias("_row"))
    df = df.filter(~F.col("value").rlike(r"(?U)^\s*$"))
    return df.groupBy("file").agg(F.min_by("value", F.struct("_blk", "_row")).alias("first"))


def _file_key(path: Column | None = None) -> Column:
    """A scanned file's name with one slash after ``file:``, as :func:`given_names` has it."""
    return F.regexp_replace(F.col("_metadata.file_path") if path is None else path, "^file:/+", "file:/")


def given_names(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """(name, position) of the given files and folders, as Spark names files; globs are expanded.
    Only given names and glob matches are listed, not the files in folders."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for i, p in enumerate(paths):
        path = jvm.org.apache.hadoop.fs.Path(os.fspath(p))
        files = path.getFileSystem(conf)
        if re.search(r"[{}\[\]*?\\]", os.fspath(p)):
            named = [s.getPath() for s in files.globStatus(path) or ()]
        else:
            named = [path]
        out += [(re.sub("^file:/+", "file:/", files.makeQualified(x).toUri().toString()), i) for x in named]
    return out


def name_ranges(names: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The given names as ranges of file names that do not overlap: (first name of the range, position).

    A name covers itself and all names that begin with it and a slash.  Where ranges overlap, the lowest
    position counts; -1 is the position of names that none covers.  Code points sort as UTF-8 bytes do.
    """
    edges: dict[str, list[tuple[int, int]]] = {"": []}
    for name, i in names:
        stem = name.rstrip("/")
        for start, stop in ((name, name + "\0"), (stem + "/", stem + "0")):
            edges.setdefault(start, []).append((i, 1))
            edges.setdefault(stop, []).append((i, -1))
    out: list[tuple[str, int]] = []
    covering, lowest = Counter(), []
    for edge in sorted(edges):
        for i, step in edges[edge]:
            covering[i] += step
            if step > 0:
                heapq.heappush(lowest, i)
        while lowest and not covering[lowest[0]]:
            heapq.heappop(lowest)
        position = lowest[0] if lowest else -1
        if not out or out[-1][1] != position:
            out.append((edge, position))
    return out


def path_position(spark: SparkSession, paths: list[str], file: Column) -> Column:
    """H2: position of the given path that a file (a :func:`_file_key`) comes from.

    A search by halves in the sorted ranges of the given names: no join, whatever the number of files, and a
    number of steps that grows with the logarithm of the number of given paths.
    """
    if len(paths) == 1:
        return F.lit(0)
    ranges = name_ranges(given_names(spark, paths))
    # names are percent-encoded: no line break stands in them
    firsts = F.split(F.lit("\n".join(r[0] for r in ranges)), "\n")
    positions = F.from_json(F.lit(str([r[1] for r in ranges])), T.ArrayType(T.IntegerType()))
    steps = max(1, (len(ranges) - 1).bit_length())
    jumps = F.lit([1 << k for k in reversed(range(steps))])
    found = F.aggregate(jumps, F.lit(0), lambda at, jump: F.when(F.get(firsts, at + jump) <= file, at + jump).otherwise(at))
    return F.get(positions, found)


def sniff_formats(spark: SparkSession, paths: list[str]) -> dict[str, str | None]:
    """Format per un-routable path from its first non-blank line: one job for any number of paths,
    one row per path to the driver (which plans one scan per path)."""
    paths = list(dict.fromkeys(paths))
    if not paths:
        return {}
    found = first_lines(spark, paths).withColumn("path", path_position(spark, paths, F.col("file")))
    found = found.groupBy("path").agg(F.min_by("first", "file").alias("first"))
    by_path = {r["path"]: r["fmt"] for r in found.select("path", sniff_format_col(F.col("first")).alias("fmt")).collect()}
    return {p: by_path.get(i) for i, p in enumerate(paths)}


# --------------------------------------------------------------------------
# Dispatch and scan
# --------------------------------------------------------------------------
def resolve_formats(spark: SparkSession, paths: list[str], fmt: str | None = None) -> dict[str, str]:
    """Explicit name -> routing -> sniffing -> ``ValueError``."""
    if fmt is not None:
        if fmt not in K.FORMATS:
            raise ValueError(f"unknown format {fmt!r}; known: {K.FORMATS}")
        return {p: fmt for p in paths}
    out = {p: route_format(p) for p in paths}
    unknown = [p for p, f in out.items() if f is None]
    for p, f in sniff_formats(spark, unknown).items():
        if f is None:
            raise ValueError(f"No parser matched {p} (pass fmt= to choose one explicitly)")
        out[p] = f
    return out


ORDER = "struct<path:int,file:string,block:bigint,row:bigint>"


def arrival_order(spark: SparkSession, paths: list[str], block: Column, row: Column, name: Column | None = None) -> Column:
    """H2: the order in which records arrive, as one sortable value: position of the given path, file name,
    start of the part of the file, row in it.  All of it comes with the scan; nothing is joined."""
    file = _file_key(name)
    return F.struct(path_position(spark, paths, file).cast("int").alias("path"), file.alias("file"),
                    block.cast("bigint").alias("block"), row.cast("bigint").alias("row"))


def with_arrival_order(df: DataFrame, paths: list[str]) -> DataFrame:
    """Lines of a text scan with ``source_file`` and ``ingest_seq``."""
    order = arrival_order(df.sparkSession, paths, F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return df.select("value", F.col("_metadata.file_path").alias("source_file"), order.alias("ingest_seq"))


def scan_records(spark: SparkSession, paths: list[str], fmt: str, given: list[str] | None = None) -> DataFrame:
    """Records of one format: ``value`` (a line or one JSON record) + order columns.

    Line files: A1 auth log, A2/A3 access logs, A5 Windows events one object
    per line, A6 JSON lines.

    Files ending in ``.json`` are whole JSON documents (A4, P4): an array of
    records or one object, read in pieces (:func:`json_records`).  A broken
    document fails the job, as the original does; broken *lines* never do.
    Formats that only read lines yield no records from such files.

    ``given`` are the paths of the whole call, whose order counts (default: ``paths``).
    """
    given = given or paths
    json_files = [p for p in paths if p.lower().endswith(".json")]
    line_files = [p for p in paths if not p.lower().endswith(".json")]
    frames = []
    if line_files:
        frames.append(with_arrival_order(spark.read.text(line_files), given))
    if json_files and fmt == "windows_json":
        order = arrival_order(spark, given, F.col("record"), F.col("pos"), F.col("source_file"))
        frames.append(json_records(spark, json_files).select("value", "source_file", order.alias("ingest_seq")))
    if not frames:
        return spark.createDataFrame([], f"value string, source_file string, ingest_seq {ORDER}")
    return reduce(lambda a, b: a.unionByName(b), frames)


def read_events(spark: SparkSession, paths, fmt: str | None = None, year: int | None = None,
                counters: dict[str, Observation] | None = None) -> DataFrame:
    """Many files -> one ``events`` frame (+ ``source_file``, ``ingest_seq``).

    ``counters`` gets an ``Observation`` per format, which has the numbers of ``parsed`` and ``skipped``
    records once the events have been computed: no second parse (A12).
    """
    paths = [str(p) for p in ([paths] if isinstance(paths, (str, os.PathLike)) else paths)]
    formats = resolve_formats(spark, paths, fmt)
    frames = []
    for f in K.FORMATS:
        group = [p for p in paths if formats[p] == f]
        if group:
            recs = scan_records(spark, group, f, paths)
            seen = None if counters is None else counters.setdefault(f, Observation(f"parse_{f}"))
            frames.append(P.parse(recs, f, year, counters=seen).select(*EVENT_COLUMNS, "source_file", "ingest_seq"))
    return reduce(lambda a, b: a.unionByName(b), frames)


def read_rejects(spark: SparkSession, paths, fmt: str | None = None, year: int | None = None) -> DataFrame:
    """The records that did not parse, with their file."""
    paths = [str(p) for p in ([paths] if isinstance(paths, (str, os.PathLike)) else paths)]
    formats = resolve_formats(spark, paths, fmt)
    frames = [P.rejects(scan_records(spark, [p for p in paths if formats[p] == f], f, paths), f, year)
              for f in K.FORMATS if any(formats[p] == f for p in paths)]
    return reduce(lambda a, b: a.unionByName(b), frames)


def parse_counts(spark: SparkSession, paths, fmt: str | None = None, year: int | None = None) -> DataFrame:
    """A12 counters per file: ``parsed`` and ``skipped``."""
    paths = [str(p) for p in ([paths] if isinstance(paths, (str, os.PathLike)) else paths)]
    formats = resolve_formats(spark, paths, fmt)
    frames = [P.parse_counts(scan_records(spark, [p for p in paths if formats[p] == f], f, paths), f,
                             ["source_file"], year)
              for f in K.FORMATS if any(formats[p] == f for p in paths)]
    return reduce(lambda a, b: a.unionByName(b), frames)


def parse_text(spark: SparkSession, text: str | None = None, fmt: str = "linux_auth", year: int | None = None,
               frame: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """Parse in-memory text, or a frame whose ``text_col`` holds text blobs."""
    if frame is None:
        frame = spark.createDataFrame([(text,)], f"{text_col} string")
    lines = P.lines_of_text(frame, text_col)
    return P.parse(lines, fmt, year)
