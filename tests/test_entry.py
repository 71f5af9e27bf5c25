"""The entry module: it imports without a session, and without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n[:2] == 'op' and n[2].isdigit() for n in q))"


def names(where: Path) -> tuple[int, int]:
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=where, capture_output=True, text=True, check=True).stdout.split()
    return int(out[-2]), int(out[-1])


def test_imports_with_and_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    before = names(copy)
    had = (copy / "tapeloom" / "llm").exists()
    (copy / "xxhash.py").write_text("raise ImportError('not there')")  # a package that the operators need is missing
    assert names(copy)[1] == 0 or not had
    (copy / "xxhash.py").unlink()
    shutil.rmtree(copy / "tapeloom" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    after = names(copy)
    assert after[1] == 0 and after[0] >= 340
    assert before[1] >= 13 and before[0] == after[0] + before[1] + 1 if had else before == after


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
