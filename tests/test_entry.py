import subprocess
import sys

import pytest

import __spark_entry__ as entry


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["maploom.llm", "xxhash"])
def test_imports_without_the_corpus_operators(missing):
    code = f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e; q = e.queries(); assert 'maps_alive_per_year' in q and not any(n.startswith('op1') for n in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0]).returncode == 0
