"""The driver's contract, and that the core stands without the optional subpackage."""

import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(o) > 80
    assert {f"p{n}_found" for n in (1, 3, 4, 5, 7)} <= set(q)


def test_core_does_not_import_the_subpackage():
    for f in (ROOT / "spanloom").rglob("*.py"):
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("spanloom.llm") for n in names), f


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == entry.entry(spark).columns
