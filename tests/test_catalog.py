"""The registered queries; ``check.py`` compares all of them at any scale."""

import duckdb
import pytest

import __spark_entry__ as driver
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
IDS = (
    [f"s{i}" for i in range(1, 10)]
    + [f"w{i}" for i in range(1, 7)]
    + [f"p{i}" for i in range(1, 21)]
    + [f"x{i}" for i in range(0, 19)]
    + ["x6a", "x6b", "x6c", "x6d", "u1", "u2"]
    + [f"t{i}" for i in range(1, 10)]
    + [f"k{i}" for i in range(1, 11)]
    + [f"l{i}" for i in range(1, 13)]
    + [f"d{i}" for i in range(1, 6)]
    + [f"m{i}" for i in range(1, 8)]
    + [f"a{i}" for i in range(1, 9)]
)


def test_every_operator_has_a_query():
    have = {name.split("_")[0] for name in driver.queries()}
    assert [i for i in IDS if i not in have] == []
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_returns_every_category(spark):
    assert driver.entry(spark).count() == 10


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize(
    "name",
    ["a3_leak_counts", "a6_audit_stream", "x6_contact", "p7_clean_body", "t1_shuffle", "t6_random_word_windows",
     "k7_pack_blocks", "l3_score_matrix", "l8_rank_by_ratio", "d2_noisy_sum", "m2_corpus_bleu", "s6_read_wet"],
)
def test_query_equals_its_sql(spark, db, name):
    df = driver.queries()[name](spark, SF)
    result = db.execute(driver.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())
