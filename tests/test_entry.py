import ast
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    assert __spark_entry__.entry(spark).columns == ["subreddit", "month", "slot", "pos", "slot_start", "slot_end", "n"]


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_training_data_folder():
    for p in (ROOT / "plazaflow").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            names = [getattr(n, "module", None) or ",".join(a.name for a in n.names) for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, (ast.Import, ast.ImportFrom))]
            assert not [n for n in names if "llm" in n], p


def test_entry_works_without_the_training_data_folder(tmp_path):
    import shutil

    shutil.copytree(ROOT / "plazaflow", tmp_path / "plazaflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'slot_sample_b1' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
