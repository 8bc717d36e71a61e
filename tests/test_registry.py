import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'match_score' in q and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "palimpsest").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "palimpsest").parts:
            assert not re.search(r"import.*\bllm\b|\.llm\b", path.read_text()), path
