import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(df):
    def plain(v):
        return None if v != v else float(v) if isinstance(v, decimal.Decimal) else v

    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(v) if v is not None else None for v in r)) for r in df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert cells(registry.QUERIES[name](spark, sf).toPandas()) == cells(con.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["cleanup_text", "token_windows", "dosage_fields", "lexical_score", "repeated_lines", "context_expand"])
def test_plans_stay_in_the_jvm(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_scan_reads_what_is_used(spark, sf):
    plan = registry.QUERIES["detect_lang"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
