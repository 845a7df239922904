"""A4: whole-file JSON documents (an array of records, or one object) read in pieces.

A JSON document has no line structure, so the usual way is one task and one value per file.  Here
a document is cut at every ``}``, which Spark's text source does for parts of a file in parallel, and put
together again record by record:

1. a piece knows its quotes, and how much deeper the nesting gets in it, for both cases: it begins inside a
   string, or outside (a backslash never stands right before the cut, so pieces are independent);
2. running sums over the pieces of a file (:func:`~secspark.operators.sequence.running`, chunks of equal row
   counts) tell the true case, the depth, and the number of records that end before a piece;
3. pieces of one record are grouped and joined.

So memory follows the longest record, not the file.  One more row per file, made from the listing alone, stands
for its end: there it shows whether the document is closed.  Values of an array that are not objects come
with the object after them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sequence import Run, in_chunks, running

FILE, PLACE = ["source_file"], ["_block", "_row"]
BLANK = r"[ \t\r\n]*"
END = (1 << 63) - 1
BOM = 3  # bytes that the text source leaves out


def _nesting(text: Column) -> Column:
    """Brackets opened less brackets closed, strings left out."""
    bare = F.regexp_replace(text, r'"[^"]*(?:"|\z)', "")
    return F.length(F.translate(bare, "}]", "")) - F.length(F.translate(bare, "{[", ""))


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The pieces of the files with what each tells by itself, and a row for each file's end."""
    name = F.col("_metadata.file_path").alias("source_file")
    text = spark.read.option("lineSep", "}").text(paths).select(
        name, F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"),
        "value", F.lit(None).cast("long").alias("_size"))
    ends = spark.read.format("binaryFile").load(paths).select(
        name, F.lit(END).alias("_block"), F.lit(0).cast("long").alias("_row"), F.lit("").alias("value"),
        F.col("length").alias("_size"))
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    return text.unionByName(ends).select(
        "*", F.octet_length("value").cast("long").alias("_bytes"),
        (F.length(plain) - F.length(F.regexp_replace(plain, '"', ""))).alias("_quotes"),
        _nesting(plain).alias("_outside"), _nesting(F.concat(F.lit('"'), plain)).alias("_inside"))


def _located(pieces: DataFrame) -> DataFrame:
    """Pieces with the document's kind, whether a bracket closes before the piece, its depth and its record."""
    rows = in_chunks(pieces, FILE, PLACE)
    at_end, one = F.col("_size").isNotNull(), F.lit(1).cast("long")
    rows = running(rows, FILE, PLACE, {"_n": Run(F.when(~at_end, one), own=False),
                                       "_before": Run(F.col("_bytes"), own=False),
                                       "_marks": Run(F.col("_quotes"), own=False)})
    in_text = F.col("_marks") % 2 == 1
    # The bracket at which the text was cut comes first in the next piece; a file need not end with one.
    cut = (F.col("_n") > 0) & (~at_end | (F.col("_size") - F.col("_before") - F.col("_n")).isin(0, BOM))
    kind = F.regexp_extract("value", rf"^{BLANK}([\[{{])", 1)
    rows = rows.select("*", in_text.alias("_in_text"), cut.alias("_cut"), F.when(F.col("_n") == 0, kind).alias("_first"))
    closes = F.col("_cut") & ~F.col("_in_text")
    deeper = F.when(F.col("_in_text"), F.col("_inside")).otherwise(F.col("_outside")) - closes.cast("int")
    # An object is taken for the only record of an array, so records end at depth 1 in both.
    rows = rows.withColumn("_deeper", deeper + F.when(F.col("_first") == "{", 1).otherwise(0))
    rows = running(rows, FILE, PLACE, {"_kind": Run(F.col("_first"), "last"), "_depth": Run(F.col("_deeper"), own=False)})
    rows = rows.withColumn("_closes", (closes & (F.col("_depth") == 2)).cast("long"))
    return running(rows, FILE, PLACE, {"_record": Run(F.col("_closes"))})


def _values(text: Column, kind: Column, record: Column, last: Column, name: Column) -> Column:
    """The values of one record's text as an array of JSON texts; raises if the text is no part of a document."""
    opening = F.when(record == 0, F.lit(rf"^{BLANK}\[")).otherwise(F.lit(rf"^{BLANK},"))
    closing = F.lit(rf"\]{BLANK}\z")
    only_closing = last & (record > 0) & F.regexp_like(text, F.lit(rf"^{BLANK}\]{BLANK}\z"))
    body = F.regexp_replace(text, opening, F.lit(""))
    body = F.when(last, F.regexp_replace(body, closing, F.lit(""))).otherwise(body)
    empty = F.regexp_like(body, F.lit(rf"^{BLANK}\z"))
    none = F.array().cast("array<string>")
    whole = F.regexp_like(text, opening) & (~last | F.regexp_like(text, closing))
    in_array = (F.when(only_closing, none)
                 .when(whole & empty & (record == 0), none)
                 .when(whole & ~empty, F.from_json(F.concat(F.lit("["), body, F.lit("]")), T.ArrayType(T.StringType()))))
    alone = F.regexp_replace(text, rf"^{BLANK}|{BLANK}\z", "")
    is_map = F.from_json(alone, T.MapType(T.StringType(), T.StringType())).isNotNull()
    in_object = F.when((record == 1) & last & (alone == ""), none).when((record == 0) & ~last & is_map, F.array(alone))
    found = F.when(kind == "[", in_array).when(kind == "{", in_object)
    error = F.raise_error(F.concat(F.lit("invalid JSON document: "), name)).cast(T.ArrayType(T.StringType()))
    return F.when(found.isNull(), error).otherwise(found)


def json_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(value, source_file, record, pos)``: the records of JSON documents, in the order (record, pos).

    Arrays give their values, objects themselves.  A document that is broken or not closed fails the job;
    Spark passes over files of no bytes, so they give no records.
    The pieces are written to the shared folder when this is called.
    """
    rows = _located(_pieces(spark, paths))
    at_end, after = F.col("_size").isNotNull(), F.col("_depth") + F.col("_deeper")
    closed = ~F.col("_in_text") & (after == F.when(F.col("_kind") == "{", 1).otherwise(0))

    def part(record: Column, n: int, text: Column) -> Column:
        return F.struct(record.alias("record"), F.lit(n).alias("n"), text.alias("text"))

    record, bracket = F.col("_record"), F.when(F.col("_cut"), "}").otherwise("")
    parts = F.when(F.col("_closes") == 1, F.array(part(record - 1, 0, F.lit("}")), part(record, 1, F.col("value")))) \
             .otherwise(F.array(part(record, 1, F.concat(bracket, "value"))))
    parts = rows.select(*FILE, *PLACE, "_kind", at_end.alias("_end"), (at_end & ~closed).alias("_open"), F.inline(parts))
    # the end row's closing bracket is part of the record before
    ends = F.col("_end") & (F.col("n") == 1)
    joined = parts.groupBy(*FILE, "record").agg(
        F.array_sort(F.collect_list(F.struct(*PLACE, "n", "text"))).alias("_texts"), F.max("_kind").alias("_kind"),
        F.max(ends).alias("_last"), F.max(F.col("_open")).alias("_open"))
    kind = F.when(~F.col("_open"), F.col("_kind"))
    values = _values(F.array_join(F.col("_texts.text"), ""), kind, F.col("record"), F.col("_last"), F.col("source_file"))
    return joined.select(*FILE, "record", F.posexplode(values).alias("pos", "value")).select(
        "value", "source_file", "record", "pos")
