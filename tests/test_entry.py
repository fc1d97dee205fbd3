import __spark_entry__


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).columns == ["action", "n_docs", "n_entities"]
    q = __spark_entry__.queries()
    assert len(q) > 60 and set(__spark_entry__.oracle_sql()) <= set(q)


def test_nothing_outside_imports_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent / "textward"
    for p in root.rglob("*.py"):
        assert "llm" in p.relative_to(root).parts or "textward.llm" not in p.read_text()
