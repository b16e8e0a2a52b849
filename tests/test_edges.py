"""Rows at the edges: malformed lines, wrapped headings, number zero, long parents, rows a model cannot take."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barflow.operators.structure.lines import best_line
from barflow.plans import knowledge as K
from barflow.plans import training as TR
from barflow.sources import vendors as V
from barflow.streaming import bars as ST


def test_malformed_csv_lines_are_reported(spark):
    good = "2024-01-02,1,2,0.5,1.5,100"
    df = spark.createDataFrame([("a", good), ("a", "2024-01-03,x,2,1,1,1"), ("b", "no time,1,2,0.5,1.5,100"), ("b", None)], "symbol string, value string")
    assert V.csv_lines(df.filter("value like '2024-01-02%'")).count() == 1
    assert V.csv_lines(df, strict=False).count() == 1
    assert sorted(r["problem"] for r in V.rejected_lines(df).collect()) == ["malformed", "malformed", "no time"]
    with pytest.raises(Exception, match="(malformed|no time) line"):
        V.csv_lines(df).collect()


def test_contents_keep_the_last_row_and_wrapped_headings(spark):
    line = "教你炒股票 {}：{} (2006-01-01 10:00) ......{}"
    pages = [(1, 1, ""), (1, 2, line.format(3, "first", 30)), (1, 3, "\n".join([line.format(3, "second", 31), line.format(4, "four", 40)])), (1, 9, "text 教你炒股票 7：a title\nthat wraps (2006-02-02 09:00) body"), (1, 5, line.format(3, "third", 32)), (1, 6, line.format(5, "beyond", 50))]
    p = spark.createDataFrame(pages, "book int, page int, text string")
    toc = K.toc_rows(p)
    assert sorted((r["lesson"], r["title"], r["toc_page"]) for r in toc.collect()) == [(3, "third", 32), (4, "four", 40), (5, "beyond", 50)]
    got = {r["lesson"]: (r["title"], r["toc_page"]) for r in K.toc_from_headings(p, toc).collect()}
    assert got[7] == ("a title that wraps", 9)


def test_number_zero_is_no_number(spark):
    body = " x" * 60
    nodes = [(1, "t", "<!-- source_page:0 -->" + body), (2, "lesson-000 教你炒股票 0：x", "<!-- source_page:7 -->" + body), (3, "lesson-012 教你炒股票 12：x", "<!-- source_page:7 -->" + body)]
    got = {r["id"]: r["chunk_id"] for r in K.tree_chunks(spark.createDataFrame(nodes, "id long, title string, raw_text string")).collect()}
    assert got == {1: "pageindex.node0001", 2: "pageindex.front.p0007", 3: "pageindex.l012.p0007"}


def test_weekly_parents_keep_all_their_days(spark, tmp_path):
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    spark.createDataFrame([("s", day(7 * w), day(7 * w + 7)) for w in range(3)], "symbol string, start_ts timestamp, end_ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([("s", day(k + 1)) for k in range(21)], "symbol string, end_ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/c")
    read = lambda n, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{n}")
    out = ST.children_of(read("p", "symbol string, start_ts timestamp, end_ts timestamp"), read("c", "symbol string, end_ts timestamp"), "7 days", late="30 days")
    q = out.writeStream.format("memory").queryName("weekly").option("checkpointLocation", f"{tmp_path}/k").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.sql("SELECT parent_end, count(*) AS n FROM weekly GROUP BY parent_end").collect()) == [7, 7, 7]


@pytest.mark.parametrize(
    "points,sign,steep,want",
    [
        ([(10, 5.0), (6, 3.0), (2, 0.0)], 1, True, (10.0, 5.0, 0.625)),
        ([(10, 5.0), (6, 3.0), (2, 0.0)], 1, False, (6.0, 3.0, 0.75)),
        ([(10, 1.0), (6, 3.0)], 1, True, (10.0, 1.0, 0.0)),
        ([(10, 1.0), (6, 3.0)], 1, False, None),
        ([(10, 1.0), (6, 3.0)], -1, False, (10.0, 1.0, -0.5)),
        ([(10, 1.0)], 1, True, None),
    ],
)
def test_best_line(spark, points, sign, steep, want):
    df = spark.createDataFrame([(points,)], "p array<struct<x:int,y:double>>")
    got = df.select(best_line(F.col("p"), F.lit(float(sign)), steep).alias("l")).first()["l"]
    assert (got and (got["x"], got["y"], got["slope"])) == want


def test_rows_a_model_cannot_take_keep_the_rule_score(spark):
    rows = [tuple([float(i % 2)] + [float((i * 7 + k) % 5) for k in range(len(TR.FEATURES))]) for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(["label double", *(f"`{f}` double" for f in TR.FEATURES)]))
    model = TR.train(df, trees=2, depth=2)
    got = TR.model_or_rule(model, df.limit(4).unionByName(df.limit(1).withColumn("rsi", F.lit(None).cast("double")))).groupBy("origin").count().collect()
    assert {r["origin"]: r["count"] for r in got} == {"model": 4, "rule": 1}


def test_second_market_and_plan_sections(spark, sf):
    """The second market is scanned by itself; the report lists its buys and sells, and the plan has four sections."""
    from barflow.plans import report, screen
    from barflow.sources import tables as T

    scan = screen.second_scan(spark, sf).cache()
    n = T.second_bars(spark, sf).groupBy("symbol").count().filter("count >= 50").count()
    assert scan.count() == n and scan.filter("symbol not like 'hk%' or length(symbol) <> 7").count() == 0
    assert scan.filter("side = 'buy' and zs = ''").count() <= scan.filter("side = 'buy'").count()
    tops = {(r.side, r.rn, r.symbol) for r in screen.second_tops(scan).collect()}
    for side in ("buy", "sell"):
        own = sorted(r.symbol for r in scan.filter(scan.side == side).collect())[:5]
        assert {(s, k, c) for s, k, c in tops if s == side} == {(side, k + 1, c) for k, c in enumerate(own)}
    lines = report.build(spark, sf).filter("section_no = 7 and row_no > 0").collect()
    assert {(r.line.split(" | ")[0], r.line.split(" | ")[1]) for r in lines} == {(s, c) for s, _, c in tops}
    plan = report.plan_sections(spark, sf).collect()
    assert {r.section for r in plan} >= {3, 4} and {r.code for r in plan if r.section == 3} == {c for _, _, c in tops}
    assert all(r.share in report.SHARES.values() and r.way in ("limit", "market") for r in plan if r.section == 2)


def test_live_prices_come_before_the_analysis(spark, sf):
    from barflow.plans import report
    from barflow.registry.context import live_quotes

    quotes = {r.symbol: r.price for r in live_quotes(spark, sf).collect()}
    rows = report.live_buy_list(spark, sf, live_quotes(spark, sf)).collect()
    assert len(quotes) > 3 and all(r.price == quotes[r.symbol] for r in rows if r.symbol in quotes)
    assert len(report.live_buy_list(spark, sf).columns) == 16
