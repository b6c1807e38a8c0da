import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_training_data_folders(tmp_path):
    shutil.copytree(ROOT / "strandflow", tmp_path / "strandflow", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):  # with and without the pipeline's file
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and s and set(s) <= set(q) and 'pipeline' not in q and not any(n.startswith('op1') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    (tmp_path / "strandflow/llm/__pycache__").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_every_query_with_sql_is_registered():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
