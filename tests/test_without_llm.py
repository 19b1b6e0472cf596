"""The rest of the library neither needs nor imports the training-data operators."""

import pathlib

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_llm():
    for path in (ROOT / "tarn").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tarn.llm" not in path.read_text(), path


def test_contract():
    import __spark_entry__ as entry

    assert callable(entry.entry) and "hybrid_search" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
