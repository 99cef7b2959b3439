"""The driver's contract holds without a session, and with the corpus
operators removed."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(set(e.oracle_sql()) - set(q)))"


def run(folder):
    return subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=folder, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_import_without_a_session():
    done = run(ROOT)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip().endswith("[]")


def test_import_without_the_corpus_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "gutterline"), tmp_path / "gutterline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    done = run(tmp_path)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[0]) > 100


def test_entry(spark, sf):
    sys.path.insert(0, ROOT)
    import __spark_entry__

    assert __spark_entry__.QUERIES["w2_dialogue_timeline"](spark, sf).count() > 0
