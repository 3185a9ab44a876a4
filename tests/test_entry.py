"""The entry points, with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 25 and {r["grade"] for r in rows} == {"낮음"}


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT / "evidra", tmp_path / "evidra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"}, timeout=100)


def test_pipeline_file_alone_is_left_out(tmp_path):
    """The optional folder is gone but the pipeline's file is still there."""
    shutil.copytree(ROOT / "evidra", tmp_path / "evidra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"}, timeout=100)


def test_errors_of_the_optional_part_arent_hidden(tmp_path):
    shutil.copytree(ROOT / "evidra", tmp_path / "evidra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "evidra/llm").mkdir()
    (tmp_path / "evidra/llm/__init__.py").write_text("")
    (tmp_path / "evidra/llm/queries.py").write_text("import no_such_module")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, env={"PATH": "/usr/bin:/bin"}, timeout=100)
    assert done.returncode and b"no_such_module" in done.stderr
