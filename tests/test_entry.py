import ast
import pathlib

ROOT = pathlib.Path(__file__).parent.parent


def test_nothing_outside_imports_the_corpus_operators():
    for p in (ROOT / "coursegrain").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p


def test_queries_and_sql_agree():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert "sample_chunks" in q and set(s) <= set(q) and len(q) > 80


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
