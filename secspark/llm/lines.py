"""Operator 12, line dedup: levelled sorted runs of line hashes.

A line's key is the line with blanks stripped at both ends and A-Z lower-cased; keys of at least
``MIN_CHARS`` code points count.  A *run* is a table of (two 64-bit hashes of the key, documents
that hold it, keeper), bucketed and sorted by the hashes, one row per key.  Runs lie in levels:

* a new batch of documents is counted per key (map-side combine, so a line that fills a third of
  the corpus is one row per task) and merge-joined with every run, bucket by bucket and without
  a shuffle of the runs.  Its *anti* part, the keys that no run holds, is new: such a key gets its
  keeper, the largest id of the batch that holds it.  The other keys only add to the count.  The
  batch then becomes a run of level 0;
* when a level holds ``FANOUT`` runs, they are merged into one run of the next level, so a store
  of n batches has few runs per level and rewrites each row about log(n) times.

A store is a folder.  A run's name tells its level and the batches it covers; a run without
Spark's ``_SUCCESS`` file is ignored and a run inside the range of another one has been merged
into it, so a job that dies at any moment leaves a store that opens again.

:func:`dedup_lines` feeds a whole table batch by batch, from the largest ids down: the batch
in which a key is new then holds its largest id.  Keys found in at least ``MIN_DOCS`` documents
lose all their lines except in the keeper.  The decision goes back to the lines by a join on the
hashes; the at most ``HOT`` keys that hold one in ``HOT`` of all occurrences are broadcast (that
is their bound), so no key that is joined by shuffle is hot.

DataFrame functions only: no Python, Arrow or RDD code.

Defined results: a null or empty text is one empty line; each row is a document, so repeated rows
count as often as they stand, and all rows of the keeper's id keep the line; null ids are
below every other id; a tie of equal ids keeps all of them; ids are numbers; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.common import materialise, scratch, table

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
HOT = 1000
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]

#: The query in DuckDB SQL.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
crowded AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.line, l.pos, c.key IS NOT NULL AND l.doc_id <> c.keeper AS dropped
  FROM lines l LEFT JOIN crowded c ON l.key = c.key)
SELECT doc_id, count(*) AS n_lines, count_if(dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only (``lower`` does just that where every character is one byte)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def two_hashes(value: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes: with 128 bits, different values do not meet."""
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def line_marks(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: its id, two hashes of its text, and the hashes and positions of its
    long lines, sorted so that equal keys are neighbours."""
    text = F.coalesce("text", F.lit(""))
    t1, t2 = two_hashes(text)
    keys = F.transform(F.split(ascii_lower(text), "\n", -1),
                       lambda line, i: F.struct(i.alias("pos"), F.btrim(line, F.lit(BLANKS)).alias("key")))

    def mark(x: Column) -> Column:
        h1, h2 = two_hashes(x["key"])
        return F.struct(h1.alias("h1"), h2.alias("h2"), x["pos"].alias("pos"))

    long = F.filter(keys, lambda x: F.char_length(x["key"]) >= min_chars)
    return docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), F.array_sort(F.transform(long, mark)).alias("marks"))


def key_counts(marks: DataFrame, *by: str) -> DataFrame:
    """Documents per key and the largest id that holds it."""
    def first(m: Column, i: Column) -> Column:
        before = F.get(F.col("marks"), i - 1)
        return F.struct(m["h1"].alias("h1"), m["h2"].alias("h2"),
                        ((i == 0) | (before["h1"] != m["h1"]) | (before["h2"] != m["h2"])).alias("first"))

    lines = marks.select(*by, "doc_id", F.explode(F.transform("marks", first)).alias("m")).filter("m.first")
    return (lines.groupBy(*by, F.col("m.h1").alias("h1"), F.col("m.h2").alias("h2"))
                 .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")))


class LineRuns:
    """Levelled sorted runs of line keys under a folder that all executors share."""

    NAME = re.compile(r"run-(\d+)-(\d+)-(\d+)-(\d+)-[0-9a-f]{32}$")

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.runs: list[tuple[int, int, int, str]] = []  # level, first batch, last batch, catalog name
        found = []
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(conf)
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            m = self.NAME.match(status.getPath().getName())
            if m and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append((*map(int, m.groups()), m.group()))
        # A wider run holds the runs inside its range.
        live = []
        for level, first, last, n, name in sorted(found, key=lambda r: (r[1] - r[2], r[4])):
            if not any(a <= first and last <= b for _, a, b, _, _ in live):
                live.append((level, first, last, n, name))
        live.sort(key=lambda r: r[1])
        self.buckets = live[0][3] if live else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        for level, first, last, _, name in live:
            id_type = spark.read.parquet(f"{self.path}/{name}").schema["keeper"].dataType.simpleString()
            here = f"line_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {here} (h1 BIGINT, h2 BIGINT, n BIGINT, keeper {id_type}) USING PARQUET "
                      f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.runs.append((level, first, last, here))

    def write(self, rows: DataFrame, level: int, first: int, last: int) -> None:
        folder = f"run-{level}-{first}-{last}-{self.buckets}-{uuid.uuid4().hex}"
        name = f"line_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, *KEY).write.option("path", f"{self.path}/{folder}")
             .bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name))
        self.runs.append((level, first, last, name))

    def merge_marked(self, batch: DataFrame) -> DataFrame:
        """The batch's keys merge-joined with every run: ``new`` where none holds the key (the anti-join)."""
        marked, new = batch.repartition(self.buckets, *KEY), F.lit(True)
        for k, (_, _, _, name) in enumerate(self.runs):
            run = self.spark.table(name).select(*KEY, F.lit(True).alias(f"in_{k}")).hint("merge")
            marked, new = marked.join(run, KEY, "left"), new & F.col(f"in_{k}").isNull()
        return marked.select(*KEY, "n", "keeper", new.alias("new"))

    def add(self, batch: DataFrame) -> None:
        """Add a batch of key counts (``h1, h2, n, keeper``) as a run; merge the levels that are full."""
        number = max([last for _, _, last, _ in self.runs], default=-1) + 1
        self.write(self.merge_marked(batch).select(*KEY, "n", F.when(F.col("new"), F.col("keeper")).alias("keeper")),
                   0, number, number)
        while True:
            level = self.runs[-1][0]
            full = [r for r in self.runs if r[0] == level]
            if len(full) < self.fanout:
                return
            merged = self.merged([r[3] for r in full])
            self.runs = [r for r in self.runs if r[0] != level]
            self.write(merged, level + 1, full[0][1], full[-1][2])
            for _, _, _, name in full:
                self.spark.sql(f"DROP TABLE {name}")

    def merged(self, names: list[str]) -> DataFrame:
        """Runs merge-joined into one, bucket by bucket.  (Not a union with an aggregate: Spark 4.1.2 takes the union
        of two bucketed scans for bucketed, but strings their partitions together.)"""
        out = self.spark.table(names[0])
        for name in names[1:]:
            a, b = out.alias("a"), self.spark.table(name).alias("b")
            out = (a.join(b.hint("merge"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in KEY], "full_outer")
                    .select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in KEY],
                            (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"),
                            F.coalesce("a.keeper", "b.keeper").alias("keeper")))
        return out

    def counts(self) -> DataFrame:
        """Documents and keeper of every key in the store."""
        return self.merged([r[3] for r in self.runs])

    def close(self) -> None:
        """Forget the catalog names; the runs stay in their folder."""
        for _, _, _, name in self.runs:
            self.spark.sql(f"DROP TABLE {name}")
        self.runs = []


def in_batches(docs: DataFrame, batches: int) -> Column:
    """The batch of a row: ranges of falling ids of about equal size, null ids last."""
    shares = [1 - (k + 1) / batches for k in range(batches - 1)]
    cuts = (docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] if shares else None) or []
    batch = F.lit(len(cuts))
    for k in reversed(range(len(cuts))):
        batch = F.when(F.col("doc_id") > cuts[k], k).otherwise(batch)
    return batch


def dropped_lines(marks: DataFrame, counts: DataFrame, min_docs: int, hot: int = HOT) -> DataFrame:
    """Positions of the lines that go, one row per document that loses some."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    crowded = counts.filter(F.col("n") >= min_docs)
    common = F.col("n") * hot >= F.lit(total)  # at most ``hot`` keys: their counts add up to no more than the total
    lines = marks.select("doc_id", "t1", "t2", F.inline("marks"))
    top = F.broadcast(crowded.filter(common))
    found = lines.join(top, KEY).unionByName(
        lines.join(top.select(*KEY), KEY, "left_anti").join(crowded.filter(~common), KEY))
    return (found.filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
                 .groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("gone")))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES,
                store: str | None = None, hot: int = HOT) -> DataFrame:
    """Drop crowded lines: ``doc_id, n_lines, n_dropped, text`` (what is left), one row per document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    batch = in_batches(docs, batches)
    marks = materialise(line_marks(docs, min_chars), "line-marks")
    counted = scratch(spark, "line-counts")
    key_counts(marks.withColumn("batch", batch), "batch").write.partitionBy("batch").parquet(counted)
    schema = f"h1 long, h2 long, n long, keeper {docs.schema['doc_id'].dataType.simpleString()}, batch int"
    runs = LineRuns(spark, store or scratch(spark, "line-runs"))
    for k in range(batches):
        runs.add(spark.read.schema(schema).parquet(counted).filter(F.col("batch") == k).drop("batch"))
    gone = materialise(dropped_lines(marks, runs.counts(), min_docs, hot), "line-dropped")
    runs.close()
    text = F.coalesce("text", F.lit(""))
    t1, t2 = two_hashes(text)
    # Split below the join: above it the lines are a column that lambdas read in place.
    split = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), F.split(text, "\n", -1).alias("lines")).alias("d")
    g = gone.alias("g")
    both = split.join(g, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.t1") == F.col("g.t1"))
                      & (F.col("d.t2") == F.col("g.t2")), "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")),
                       lambda i: F.get(F.col("lines"), i))
    return both.select(F.col("d.doc_id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"),
                       F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
                       F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n").alias("text"))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
