import re

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ["books", "chapters", "segments", "characters", "aliases", "voices", "documents", "eval_passages", "events"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not re.match(r"p\d_", n)))
def test_query_equals_sql(spark, small_tables, name):
    df = entry.queries()[name](spark, small_tables)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_tables}/{t}.parquet')")
    rel = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    wanted = sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=repr)
    clean = lambda rows: [tuple(round(float(v), 6) if not isinstance(v, (str, bool, int, type(None))) else v for v in r) for r in rows]
    assert sorted(names) == cols and clean(got) == clean(wanted)


def test_only_the_subpackage_itself_may_be_absent(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def absent(module):
        def run(name, globals=None, locals=None, fromlist=(), level=0):
            if name == "lorewright.llm":
                raise ModuleNotFoundError(f"No module named '{module}'", name=module)
            return real(name, globals, locals, fromlist, level)

        return run

    monkeypatch.delitem(sys.modules, "__spark_entry__")
    monkeypatch.setattr(builtins, "__import__", absent("lorewright.llm"))
    assert not any(re.match(r"p\d_", n) for n in importlib.import_module("__spark_entry__").queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    monkeypatch.setattr(builtins, "__import__", absent("regex"))
    with pytest.raises(ModuleNotFoundError):
        importlib.import_module("__spark_entry__")
