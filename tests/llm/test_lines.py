import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from secspark.llm import lines

WS = " \t\n\x0b\x0c\r"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(WS))


def brute(rows, min_chars, min_docs):
    held = defaultdict(list)
    for n, (doc_id, text) in enumerate(rows):
        for k in {key_of(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].append((n, doc_id))
    keeper = {k: max((d for _, d in v if d is not None), default=None) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for doc_id, text in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if key_of(x) not in keeper or keeper[key_of(x)] == doc_id]
        out.append((doc_id, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "text").collect()], key=str)


@pytest.fixture(scope="module")
def line_rows():
    common = "This line stands in many documents, again and again, for ever"
    out = [(i, f"own line of number {i} that no other document has at all\n  {common.upper() if i % 2 else common}\t\nend") for i in range(12)]
    out += [(20, common + "\n" + common + "\n\n"), (21, "\n".join([common] * 3)), (22, "x" * 39), (23, "x" * 40)]
    out += [(30 + i, "ÀÉÎ " * 10 + "Straße \nİ" + "ab" * 30 + "\n") for i in range(5)]
    out += [(40 + i, "àÉÎ " * 10 + "Straße \r\n") for i in range(3)]
    out += [(None, common), (None, common), (7, "second row of one id\n" + common), (50, None), (51, ""), (52, "\n\n\n"), (53, " \x0b\x0c" + common + "\x00")]
    out += [(60 + i, "y" * 40) for i in range(4)] + [(63, "y" * 40)]
    out += [(70 + i, "\n".join(f"{j:05d} numbered line of a very long document, {'z' * (j % 30)}" for j in range(3000))) for i in range(5)]
    return out


@pytest.mark.parametrize(("batches", "hot"), [(1, lines.HOT), (4, lines.HOT), (5, 2)])
def test_equals_brute_force(spark, line_rows, batches, hot):
    df = spark.createDataFrame(line_rows, "doc_id long, text string").repartition(3).select(
        "*", *[F.lit(1).alias(c) for c in ("marks", "h1", "n", "keeper", "pos", "gone", "lines", "batch", "t1")])
    assert got(lines.dedup_lines(df, batches=batches, hot=hot)) == brute(line_rows, lines.MIN_CHARS, lines.MIN_DOCS)


def test_odd_documents(spark, docs, rows, no_docs):
    plain = [(r[0], r[1]) for r in rows]
    assert got(lines.dedup_lines(docs, min_chars=5, min_docs=2)) == brute(plain, 5, 2)
    assert lines.dedup_lines(no_docs).count() == 0


def test_native_plan_and_sql(spark, tmp_path, line_rows):
    """No Python in the plans; the query equals its SQL."""
    rows = [(i, t) for i, (_, t) in enumerate(line_rows)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = lines.op12_lines(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(lines.ORACLE).fetchall())
    digest = {r[0]: hashlib.sha256(r[3].encode()).hexdigest() for r in brute(rows, 40, 5)}
    assert {r["doc_id"]: r["kept_sha256"] for r in out.collect()} == digest


def counts_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return lines.key_counts(lines.line_marks(df, 1))


def test_runs_are_kept_merged_and_opened_again(spark, tmp_path):
    store = lines.LineRuns(spark, str(tmp_path / "s"), buckets=3)
    for k in range(5):
        batch = counts_of(spark, [(100 - 10 * k, f"a\nb{k}"), (99 - 10 * k, f"c{k // 2}")])
        fresh = {r["keeper"] for r in store.merge_marked(batch).filter("new").collect()}
        assert (100 - 10 * k in fresh) and (k % 2 == 0) == (99 - 10 * k in fresh)
        store.add(batch)
    assert [(level, first, last) for level, first, last, _ in store.runs] == [(2, 0, 3), (0, 4, 4)]
    want = sorted((r["n"], r["keeper"]) for r in store.counts().collect())
    store.close()
    again = lines.LineRuns(spark, str(tmp_path / "s"), buckets=7)
    assert again.buckets == 3 and [r[:3] for r in again.runs] == [(2, 0, 3), (0, 4, 4)]
    assert sorted((r["n"], r["keeper"]) for r in again.counts().collect()) == want
    a = spark.sql("select xxhash64('a') h").first()["h"]
    assert again.counts().filter(F.col("h1") == a).first()[2:] == (5, 100)
    # A new batch is held against the stored runs: no shuffle of theirs, merge joins only.
    plan = again.merge_marked(counts_of(spark, [(1, "a\nnew")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan
    assert plan.split("SortMergeJoin", 1)[1].count("REPARTITION_BY_NUM") == 1
    assert again.merge_marked(counts_of(spark, [(1, "a\nnew")])).filter("new").count() == 1
    again.close()


def test_unfinished_run_is_ignored(spark, tmp_path):
    store = lines.LineRuns(spark, str(tmp_path / "s"), buckets=2)
    store.add(counts_of(spark, [(1, "a")]))
    store.close()
    (tmp_path / "s" / ("run-0-1-1-2-" + "0" * 32)).mkdir()
    assert [r[:3] for r in lines.LineRuns(spark, str(tmp_path / "s")).runs] == [(0, 0, 0)]


def test_batch_against_a_store(spark, tmp_path):
    """Lines that earlier batches made crowded go from a later one."""
    line = "A line that is long enough to be a key of this operator"
    first = spark.createDataFrame([(i, line) for i in range(4)], "doc_id long, text string")
    assert {r["n_dropped"] for r in lines.dedup_lines(first, batches=2, store=str(tmp_path / "s")).collect()} == {0}
    later = spark.createDataFrame([(9, line + "\nown")], "doc_id long, text string")
    assert [tuple(r) for r in lines.dedup_lines(later, batches=1, store=str(tmp_path / "s")).collect()] == [(9, 2, 1, "own")]
