import math
import unicodedata

import duckdb
import pytest

from tapeloom.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(plain(dict(zip(want.columns, r, strict=True))[c]) for c in columns) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_error_rates_of_the_whole_table(spark, sf_dir):
    from tapeloom.plans.queries import turn_pairs

    words = lambda t: [w for w in "".join(" " if unicodedata.category(c)[0] == "P" or c in "`<>|=+" else c for c in (t or "").lower()).split()]
    rows = turn_pairs(spark, sf_dir).where("hypothesis is not null").collect()
    got = {r.case_id: r.wer for r in QUERIES["reader_word_error_rate"](spark, sf_dir).collect()}
    assert len(got) == len(rows) > 0
    for r in rows:
        a, h = words(r.truth), words(r.hypothesis)
        assert got[r.case_id] == pytest.approx(edits(a, h) / len(a) if a else float(bool(h)), abs=1e-6)
