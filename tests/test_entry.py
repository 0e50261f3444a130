"""The driver contract, and that the library does without the corpus subpackage."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "veritrail"):
        source = os.path.join(REPO, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) >= 100 and set(o) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_corpus_operators():
    for folder, dirs, names in os.walk(os.path.join(REPO, "veritrail")):
        if os.path.basename(folder) == "llm":
            dirs[:] = []
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert not re.search(r"\bllm\b", f.read()), name


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[:2] == ["subject", "object"] and df.schema == __spark_entry__.entry(spark).schema
