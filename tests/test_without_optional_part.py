import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_imports_without_the_optional_subpackage():
    code = "import sys; sys.modules['mnemoframe.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_it():
    name = "mnemoframe" + ".llm"
    for p in (ROOT / "mnemoframe").rglob("*.py"):
        if "llm" not in p.parts:
            assert name not in p.read_text(), p
