"""The entry points can be imported without a session and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'op1_simhash' in q, 'pipeline' in q)"


def ask(where):
    said = subprocess.run([sys.executable, "-c", ASK], cwd=where, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return said.stdout.split()


def test_import_with_and_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "lineweave", tmp_path / "lineweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    n, simhash, pipeline = ask(tmp_path)
    assert int(n) > 150 and (simhash, pipeline) == ("False", "False")


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
