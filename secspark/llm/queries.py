"""Registered queries of the corpus operators, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from secspark.llm.align import op13_align
from secspark.llm.bpe import op6_bpe
from secspark.llm.decontam import op3_decontam
from secspark.llm.fingerprint import op10_fingerprint
from secspark.llm.langid import op1_langid
from secspark.llm.license import op2_license
from secspark.llm.lines import ORACLE as LINES_SQL
from secspark.llm.lines import op12_lines
from secspark.llm.quality import op5_quality
from secspark.llm.rank import ORACLE as RANK_SQL
from secspark.llm.rank import op11_rank
from secspark.llm.sharding import op8_sharding
from secspark.llm.simhash import op9_simhash
from secspark.llm.suffix import op4_suffix
from secspark.llm.warc import ORACLE as WARC_SQL
from secspark.llm.warc import op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_license": op2_license,
    "op3_decontam": op3_decontam,
    "op4_suffix": op4_suffix,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_warc": op7_warc,
    "op8_sharding": op8_sharding,
    "op9_simhash": op9_simhash,
    "op10_fingerprint": op10_fingerprint,
    "op11_rank": op11_rank,
    "op12_lines": op12_lines,
    "op13_align": op13_align,
}

ORACLES: dict[str, str] = {"op7_warc": WARC_SQL, "op11_rank": RANK_SQL, "op12_lines": LINES_SQL}
