import importlib
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    for path in (ROOT / "tallyvane").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tallyvane.llm" not in path.read_text(), path


def test_entry_without_the_llm_folders(tmp_path):
    """The entry point and the core queries stand without the subpackage and the pipeline."""
    for path in ("__spark_entry__.py", *(str(p.relative_to(ROOT)) for p in (ROOT / "tallyvane").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts)):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text((ROOT / path).read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') for n in q) and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
