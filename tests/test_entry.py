"""The entry points, with the corpus subpackage and without it."""

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_load_without_the_corpus_folders(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "weftline")
    for name in os.listdir(f"{ROOT}/weftline"):
        if name != "llm":
            os.symlink(f"{ROOT}/weftline/{name}", tmp_path / "weftline" / name)
    # the entry file is read by its own folder's path, so that the copy without the subpackage is what loads
    code = f"import sys; sys.path[:] = [{str(tmp_path)!r}] + [p for p in sys.path if p not in ('', {ROOT!r})]; import __spark_entry__ as e; q = e.queries(); assert 'page_overview' in q and 'pipeline' not in q and not any(n.startswith('op') and '_' in n and n[2:n.index('_')].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
