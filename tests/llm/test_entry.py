import re

import __spark_entry__ as entry
import corpus_pipeline

from tablesync.llm.queries import ORACLE, QUERIES


def test_numbered_queries_are_registered():
    found = entry.queries()
    numbers = sorted(int(m[1]) for q in found if (m := re.match(r"op(\d+)_", q)))
    assert numbers == list(range(1, 14)) and "pipeline" in found
    assert set(QUERIES) <= set(found)


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "SentencePiece encoding"
    ]
