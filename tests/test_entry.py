import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_sql_belong_together():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values()) and all(isinstance(s, str) for s in sql.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "doc_kind" in df.columns


def test_library_imports_without_the_subpackage():
    """Nothing outside of the subpackage imports it."""
    code = "import sys; sys.modules['graphloom.' + 'llm'] = None\nimport __spark_entry__ as e\nassert not any(n[0] == 'p' and n[1].isdigit() for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
