"""Extra columns with names that operators use themselves: they pass through, or are ignored."""

import pytest
from pyspark.sql import functions as F

from tablesync.llm.fingerprint import with_fingerprint
from tablesync.llm.lines import line_dedup
from tablesync.llm.mixing import mix, mixed_documents
from tablesync.llm.pieces import round_trip
from tablesync.llm.pii import find_personal_data
from tablesync.llm.quality import kept_documents, quality_rules
from tablesync.llm.secrets import secret_scan
from tablesync.llm.simhash import near_dedup
from tablesync.llm.suffixes import repeated_substrings

NAMES = """_row _lines _gone _gone_id _gone_row _kept _places _mix_id _mix_row _mix_copies _copy id row key size lines words
    value start end score kept fp label sig bands sketch uid anchor ids decoded bucket _ROW _met _keep print grams""".split()


def rows(df, columns):
    return sorted(tuple(str(v) for v in r) for r in df.select(*(F.col(f"`{c}`") for c in columns)).collect())


@pytest.fixture(scope="module")
def plain(spark, documents):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    texts = [f"{own(i)}\nThe same line in every one of these.\ntoken = \"{i:040x}\" mail{i}@example.org" for i in range(30)]
    return documents(spark, [*texts, texts[3], None, ""])


@pytest.fixture(scope="module")
def wide(plain):
    taken = {c.lower() for c in plain.columns}
    names = [n for n in NAMES if n.lower() not in taken]
    lower = list({n.lower(): n for n in names}.values())
    return plain.select("*", *(F.lit(f"given {n}").alias(n) for n in lower))


@pytest.mark.parametrize("operator", [line_dedup, kept_documents, mixed_documents, near_dedup])
def test_columns_pass_through(plain, wide, operator):
    got = operator(wide)
    own = [c for c in wide.columns if c not in plain.columns]
    assert set(wide.columns) <= set(got.columns)
    assert all(v == f"given {c}" for r in got.select(own).distinct().collect() for c, v in r.asDict().items())
    assert rows(got, plain.columns) == rows(operator(plain), plain.columns)


@pytest.mark.parametrize("operator", [quality_rules, mix, find_personal_data, secret_scan, repeated_substrings, round_trip])
def test_columns_are_ignored(plain, wide, operator):
    wanted = operator(plain)
    columns = [c for c, t in wanted.dtypes if t not in ("binary",)]
    got = operator(wide)
    assert set(columns) <= set(got.columns) and rows(got, columns) == rows(wanted, columns)


def test_fingerprint_columns(plain, wide):
    wanted = with_fingerprint(plain, "text", "own_print")
    assert rows(with_fingerprint(wide, "text", "own_print"), ["doc_id", "own_print"]) == rows(wanted, ["doc_id", "own_print"])
