import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from foliate import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_as_sql(name, spark, sf_dir, same):
    same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(catalog.ORACLE) <= set(__spark_entry__.oracle_sql())


def test_entry_without_the_optional_part(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path) if (root / name).exists() else None
    shutil.copytree(root / "foliate", tmp_path / "foliate", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalog.QUERIES), sorted(e.oracle_sql()) == sorted(e.catalog.ORACLE))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.stdout.split() == ["True", "True"], done.stderr
