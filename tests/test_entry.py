import __spark_entry__ as registry


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_runs(spark):
    df = registry.entry(spark)
    assert {r["engine"] for r in df.collect()} == {"alpha", "beta"} and "recall" in df.columns


def test_the_rest_needs_nothing_of_the_corpus_subpackage():
    from pathlib import Path

    root = Path(registry.ROOT)
    rest = [p for p in (root / "inkgauge").rglob("*.py") if "llm" not in p.parts] + list((root / "tests").glob("*.py"))
    assert rest and not [p for p in rest if "inkgauge." + "llm" in p.read_text()]
