"""Functions that run in tasks must load where this package is not installed."""

import subprocess
import sys

from pyspark import cloudpickle

from gleaner.models import explain
from gleaner.operators import microsegments


def test_task_functions_load_without_the_package(tmp_path):
    path = tmp_path / "f.bin"
    leaf = explain.Leaf([0], [[(explain.Node(1.0, 1.0, 0.0, 0, 0.5), True)]], [0.5], 1.0)
    path.write_bytes(cloudpickle.dumps((explain._contributions, microsegments._bitmap_counter(2, [(0, 1)]), leaf)))
    code = f"import pickle; f, g, leaf = pickle.load(open({str(path)!r}, 'rb')); print(f.__name__, g.__name__, leaf.features)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["_contributions", "count", "[0]"], done.stderr


def test_first_rows_are_capped_as_the_table_is_read(spark, monkeypatch):
    """a9_first_rows sends no rows through a fixed number of parts, each of which would grow with the table."""
    from catalog import QUERIES, load_all
    from gleaner.sources import tables

    load_all()
    seen, cap = [], tables.cap_rows
    monkeypatch.setattr(tables, "cap_rows", lambda df, n: (seen.append(df), cap(df, n))[1])
    row = QUERIES["a9_first_rows"](spark, "/root/testdata/sf0.001").first()
    assert row["n_rows"] <= 20_000 and "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()
