"""The entry module with and without the subpackage for training data."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_llm(tmp_path):
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') and n[2].isdigit()]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_without_the_tokenizers(tmp_path):
    """A subpackage that is there but cannot be imported does not stop the rest."""
    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not [n for n in q if n.startswith('op') and n[2].isdigit()]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}"})


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "tidemark")):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "tidemark.llm" not in f.read(), n
