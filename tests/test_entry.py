import importlib
import sys

import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["name", "n"] and df.count() > 5


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_but_the_corpus_part_works_without_it(monkeypatch):
    """Whether it is gone or what it needs isn't there."""
    for gone in (["loomtag.llm", "corpus_pipeline"], ["xxhash"]):
        with monkeypatch.context() as m:
            for name in [x for x in sys.modules if x.startswith("loomtag.llm") or x == "corpus_pipeline"]:
                m.delitem(sys.modules, name)
            for name in gone:
                m.setitem(sys.modules, name, None)
            found = importlib.reload(entry).queries()
            assert "P20_tag_frequency" in found and "pipeline" not in found
            assert gone == ["xxhash"] or not any(n.startswith("op") for n in found)
    importlib.reload(entry)
