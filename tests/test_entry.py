"""The library without the optional training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_training_data_subpackage(tmp_path):
    for name in ("voxfield", "__spark_entry__.py"):
        at = ROOT / name
        if at.is_dir():
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(at, tmp_path / name)
    say = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') and n[2].isdigit() for n in q), set(e.oracle_sql()) <= set(q))"
    for pipeline in (False, True):
        if pipeline and not (ROOT / "corpus_pipeline.py").exists():
            break
        if pipeline:
            shutil.copy(ROOT / "corpus_pipeline.py", tmp_path / "corpus_pipeline.py")
        out = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) > 140 and out[1:] == ["False", "False", "True"]
