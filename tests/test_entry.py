import importlib.util
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (2, 3, 4, 6, 7)} <= set(entry.queries())


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "railweave").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "railweave").parts:
            assert "railweave.llm" not in path.read_text().replace("``railweave.llm``", "")


def test_import_needs_no_session():
    code = "import railweave, sys; assert 'pyspark' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
