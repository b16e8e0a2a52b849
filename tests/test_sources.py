import json

import pytest
from pyspark.sql import functions as F

from barflow.operators import bars as B
from barflow.plans import portfolio as PF
from barflow.sources import sinks, vendors as V
from barflow.sources import tables as T


def test_walk_bars_do_not_depend_on_the_order_ranges(spark, sf):
    a = T.walk_bars(spark, sf, 20)
    b = T.walk_bars(spark, sf, 3)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_csv_bars(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("time_key,open,high,low,close,volume,turnover,turnover_rate\n2024-01-02,1,2,0.5,1.5,10,15,0.1\n2024-02-02 10:30:00,1,2,0.5,1.6,10,15,0.1\n")
    assert V.read_bar_csv(spark, str(p), end="2024-01-31").count() == 1
    bad = tmp_path / "b.csv"
    bad.write_text("time_key,open,high,low,close,volume,turnover,turnover_rate\n2024-01-02,1,x,0.5,1.5,10,15,0.1\n")
    with pytest.raises(Exception):
        V.read_bar_csv(spark, str(bad)).collect()


def test_tsv_kind_comes_from_the_header(spark, tmp_path):
    p = tmp_path / "s.tsv"
    p.write_text("日期\t价格\t升跌\t升跌(%)\t沽空股数\t沽空金额\t成交金额\t占大巿沽空比率\t沽空比率\t3天平均\t5天平均\n2024-01-02\t10\t0\t0\t5\t1\t1\t1\t12.5\t11\t10\n")
    assert V.read_tsv(spark, str(p)).first().short_ratio == 12.5
    q = tmp_path / "u.tsv"
    q.write_text("a\tb\n")
    with pytest.raises(ValueError):
        V.read_tsv(spark, str(q))


def test_cards_skip_index_and_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"card_id": "a", "aliases": ["x"], "source_cards": [{"video_id": "v", "time_range": [0.5, 2]}]}, indent=1))
    (tmp_path / "index.json").write_text("{}")
    (tmp_path / "broken.json").write_text("{not json")
    assert [r.file for r in V.read_cards(spark, str(tmp_path)).collect()] == ["a"]


def test_chunks_strict_mode(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"chunk_id": "1", "text": "a"}\nnot json\n')
    assert V.read_chunks(spark, str(p), strict=False).count() == 1
    with pytest.raises(Exception):
        V.read_chunks(spark, str(p)).collect()


@pytest.mark.parametrize("block", [7, 40, 10**6])
def test_vendor_data_source(spark, tmp_path, block):
    """Byte ranges of any size give each line once; bad cells are reported, and files of other symbols are not opened."""
    from barflow.sources.datasource import register

    head = "time_key,open,high,low,close,volume\n"
    (tmp_path / "s1.csv").write_text(head + "2024-01-02,1,2,0.5,1.5,10\n2024-01-03,1,x,0.5,1.6,10\n\n2024-01-04,1,2,0.5,1.7,\n2024-01-05,1,2\n2024-01-06,1,2,0.5,1.8,3", encoding="utf-8-sig")
    (tmp_path / "symbol=s3").mkdir()
    (tmp_path / "symbol=s3" / "part-0.csv").write_text(head + "2024-01-02,3,3,3,3,3\r\n")
    (tmp_path / "_hidden.csv").write_text("nothing")
    (tmp_path / "s2.json").write_text(json.dumps({"day": [["2024-01-02", "1", "1.5", "2", "0.5"], ["2024-01-03", "1", "?", "2", "0.5"], "x"]}))
    (tmp_path / "s4.json").write_text("{broken")
    register(spark)
    csv = spark.read.format("vendor_bars").option("block", block).load(str(tmp_path))
    rows = {(r.symbol, r.time_key): r for r in csv.collect()}
    assert len(rows) == csv.count() == 6
    assert rows["s1", "2024-01-02"].close == 1.5 and rows["s3", "2024-01-02"].volume == 3.0 and rows["s1", "2024-01-04"].volume == 0.0
    assert {k[1] for k, r in rows.items() if r.bad} == {"2024-01-03", "2024-01-05"} and rows["s1", "2024-01-03"].high is None
    some = csv.filter("symbol = 's1' and time_key >= '2024-01-04' and time_key < '2024-01-06'")
    assert sorted(r.time_key for r in some.collect()) == ["2024-01-04", "2024-01-05"]
    (tmp_path / "s9.csv").write_bytes(b"\xff\xfe broken")
    assert some.count() == 2
    arrays = spark.read.format("vendor_bars").option("layout", "arrays").load(str(tmp_path)).collect()
    assert sorted((r.symbol, r.time_key or "", r.bad is None) for r in arrays) == [("s2", "", False), ("s2", "2024-01-02", True), ("s2", "2024-01-03", False), ("s4", "", False)]
    with pytest.raises(Exception):
        spark.read.format("vendor_bars").option("layout", "nope").load(str(tmp_path)).count()


def test_vendor_stream_takes_each_file_once(spark, tmp_path):
    from barflow.sources.datasource import register
    from barflow.streaming.bars import to_folder

    register(spark)
    (tmp_path / "in").mkdir()
    head = "time_key,open,high,low,close,volume\n"
    for n in range(3):
        (tmp_path / "in" / f"s{n}.csv").write_text(head + f"2024-01-0{n + 1},1,2,0.5,1.5,{n}\n")
        to_folder(spark.readStream.format("vendor_bars").load(str(tmp_path / "in")), str(tmp_path / "out"), "append")
        got = spark.read.parquet(str(tmp_path / "out/data")).collect()
        assert sorted(r.volume for r in got) == [float(k) for k in range(n + 1)]


def test_versioned_store(spark, tmp_path):
    """One version per write that went through; failed writes leave neither a version nor, of tasks that ended, a file."""
    from barflow.sources import store

    path = str(tmp_path / "t")
    df = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k long, v string")
    with pytest.raises(FileNotFoundError):
        store.read_versioned(spark, path)
    store.write_versioned(df.repartition(3), path)
    bad = df.withColumn("v", F.when(F.col("k") == 19, F.raise_error(F.lit("lost midway")).cast("string")).otherwise(F.col("v")))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="lost midway"):
            store.write_versioned(bad.repartition(3), path, mode)
    assert store.versions(path) == [1] and sorted(map(tuple, store.read_versioned(spark, path).collect())) == sorted(map(tuple, df.collect()))
    store.write_versioned(df.limit(0), path, "append")
    store.merge_versioned(spark.createDataFrame([(3, "new"), (3, "newer"), (50, None), (None, "n")], "k long, v string"), path, ["k"])
    want = {(i, f"v{i}") for i in range(20) if i != 3} | {(3, "newer"), (50, None), (None, "n")}
    assert {tuple(r) for r in store.read_versioned(spark, path).collect()} == want and store.read_versioned(spark, path).count() == 22
    assert store.read_versioned(spark, path, 1).count() == 20 and store.versions(path) == [1, 2, 3]
    assert store.vacuum(path, keep=1) > 0 and store.versions(path) == [3]
    assert store.read_versioned(spark, path).count() == 22


def test_a_version_is_taken_once(spark, tmp_path):
    from barflow.sources import store

    schema = spark.createDataFrame([], "k long").schema
    first, second = (store.VersionedWriter(str(tmp_path / "t"), schema, True) for _ in range(2))
    first.commit([])
    with pytest.raises(RuntimeError):
        second.commit([])
    assert store.versions(str(tmp_path / "t")) == [1]


def test_json_without_a_schema(spark, tmp_path):
    text = '{"a": "x\\"y: {z}", "b": [1, 2.5, {"c": true, "d": null}], "key:": "", "e": {"f": "\\u4e2d", "g": -3e2}}'
    x = spark.createDataFrame([(text,), ("{}",), ("",)], "t string").select(V.json_leaves(F.col("t")).alias("l"), V.record_text(F.col("t")).alias("r")).collect()
    assert x[0].l == ['x"y: {z}', "1", "2.5", "True", "", "中", "-3e2"] and x[0].r == 'x"y: {z} 1 2.5 True 中 -3e2'
    assert x[1].l == [] and x[2].r == ""
    (tmp_path / "l.jsonl").write_text('{"k": 1}\n\n[1]\noops\n' + "\n".join(json.dumps({"k": n}) for n in range(5000)))
    good, bad = V.read_json_lines(spark, str(tmp_path / "l.jsonl"))
    assert sorted((r.line, r.text) for r in bad.collect()) == [(3, "[1]"), (4, "oops")]
    got = {r.line: r.k for r in good.select("line", F.variant_get("v", "$.k", "int").alias("k")).collect()}
    assert got == {1: 1} | {n + 5: n for n in range(5000)}


def test_level_order():
    B.check_level_order(["day", "60m", "5m"])
    with pytest.raises(ValueError):
        B.check_level_order(["5m", "day"])


def test_resampled_levels(spark, sf):
    t = T.load(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    for level in ("5m", "day", "month"):
        b = B.resample_level(t, level)
        assert b.agg(F.sum("volume")).first()[0] == t.count() and b.filter("high < low").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 1, "b"), (1, 1, "a")], "section_no int, row_no int, line string")
    sinks.write_report(df, str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["a", "b"]
    pos = spark.createDataFrame([("x", "n", 5.0, 1)], "code string, name string, cost double, qty int")
    sinks.rewrite_positions(PF.upsert(pos, spark.createDataFrame([("x", "n", 0.0, 3), ("y", "m", 2.0, 4)], pos.schema)), str(tmp_path / "p"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("x", "n", 5.0, 3), ("y", "m", 2.0, 4)}
    with pytest.raises(Exception):
        sinks.rewrite_positions(pos, str(tmp_path / "p"))
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_filters_reach_the_scan(spark, sf):
    df = T.load(spark, sf, "lineitem").filter("l_suppkey = 3").select("l_quantity")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_suppkey), EqualTo(l_suppkey,3)]" in plan
    assert "l_comment" not in plan and "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in plan


def test_long_strings_do_not_overflow_the_stack(spark):
    long = 'wörd "x" \\ ' * 20000
    df = spark.createDataFrame([(json.dumps({"a": long, "b": [1, long]}, ensure_ascii=False),)], "t string")
    got = df.select(V.json_leaves(F.col("t")).alias("l")).first().l
    assert got == [long, "1", long]


def test_saved_model_takes_odd_balances(spark, tmp_path):
    """Negative zero, not a number and nothing fall where SQL puts them."""
    from barflow.registry.stores import saved_model

    rows = [(1, -0.0), (2, 0.0), (3, -0.01), (4, 4999.99), (5, 5000.0), (6, float("nan")), (7, None), (8, float("inf")), (9, float("-inf"))]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.c_custkey: r["class"] for r in saved_model(spark, str(tmp_path)).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.0, 4: 1.0, 5: 2.0, 6: 2.0, 7: 2.0, 8: 2.0, 9: 0.0}


def test_small_vendor_files_share_tasks(spark, tmp_path):
    from barflow.sources.datasource import VendorReader, register

    for n in range(300):
        (tmp_path / f"s{n}.csv").write_text(f'time_key,open,high,low,close,volume\n2024-01-02,1,2,0.5,1.5,{n}\n"2024-01-03",1,2,0.5,1.5,1\n2024-01-04,x,2,0.5,1.5,1')
    pieces = VendorReader({"path": str(tmp_path)}).partitions()
    assert len(pieces) == 1 and len(pieces[0].ranges) == 300
    register(spark)
    x = spark.read.format("vendor_bars").load(str(tmp_path))
    got = x.groupBy("symbol").agg(F.count("*").alias("n"), F.count("bad").alias("bad"), F.sum("volume").alias("v"))
    assert {(r.symbol, r.n, r.bad, r.v) for r in got.collect()} == {(f"s{n}", 3, 1, n + 2.0) for n in range(300)}
