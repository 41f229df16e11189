import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(f"{ROOT}/tickwarden", tmp_path / "tickwarden", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 150 and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, names in os.walk(f"{ROOT}/tickwarden"):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                assert "tickwarden.llm" not in open(os.path.join(folder, name)).read()
