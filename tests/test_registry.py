import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# one or two per family; tools/verify.py runs all of them
SAMPLE = ["agg01_walk_bars", "ind06_macd", "ind16_directional_index", "src05_localised_bars", "join04_children", "str08_strokes", "rule14_regime_decision", "rule16_leaders",
          "set06_pf01_upsert", "hk04_composite", "mac01_macro_bias", "kb05_top08_search", "kb08_windows", "top02_quick_rank", "stm08_tumbling_bars",
          "str10_settled_attributes", "join15_settled_strokes", "kb12_tree_chunks", "kb14_toc", "rule28_fusion", "hk02_warrants"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 180


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted([plain(r[c]) for c in cols] for r in df.collect())
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted([plain(r[names.index(c)]) for c in cols] for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 10
