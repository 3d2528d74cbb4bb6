"""The repository without the corpus operators: the engine's queries are all there."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; from tessera.plans.catalogue import QUERIES, SQL; assert set(e.queries()) == set(QUERIES); assert set(e.oracle_sql()) == set(SQL); print('ok')"


@pytest.mark.parametrize("removed", [("tessera/llm",), ("corpus_pipeline.py",), ("tessera/llm", "corpus_pipeline.py")])
def test_engine_alone(tmp_path, removed):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "tessera"):
        if not (HERE / name).exists():
            continue
        (shutil.copytree if (HERE / name).is_dir() else shutil.copy)(HERE / name, tmp_path / name)
    for name in removed:
        path = tmp_path / name
        if path.exists():
            shutil.rmtree(path) if path.is_dir() else path.unlink()
    ask = ASK if "tessera/llm" in removed or not (HERE / "tessera/llm").exists() else ASK.replace("==", ">=")
    done = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False)
    assert done.stdout.strip() == "ok", done.stderr


def test_other_missing_modules_are_errors():
    import __spark_entry__ as e

    with pytest.raises(ModuleNotFoundError):
        e._optional("tessera.nothing")
