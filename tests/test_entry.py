import os
import re
import subprocess
import sys

import __spark_entry__ as E


def test_contract_keys_match():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 30


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"families", "severity", "n_alerts"}
    assert df.count() > 0


def test_entry_works_without_the_corpus_operators():
    code = ("import sys, warnings; warnings.simplefilter('ignore'); sys.modules['secspark.llm'] = None; "
            "sys.modules['corpus_pipeline'] = None; import __spark_entry__ as E; "
            "names = set(E.queries()); assert len(names) >= 39 and 'pipeline' not in names, names; "
            "assert not any(n.startswith('op') and '_' in n and n[2].isdigit() for n in names)")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(E.__file__)))


def test_nothing_else_imports_the_corpus_operators():
    root = os.path.dirname(os.path.abspath(E.__file__))
    for folder, _, names in os.walk(os.path.join(root, "secspark")):
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n), encoding="utf-8") as f:
                        assert not re.search(r"\bllm\b", f.read()), n
