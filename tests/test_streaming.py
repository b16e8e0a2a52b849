from pyspark.sql import functions as F

from barflow.operators import structure as S
from barflow.plans import training as TR
from barflow.streaming import bars as ST
from barflow.streaming import stateful as SF

COLS = ["symbol", "idx", "dir", "is_sure", "begin_mb", "end_mb", "begin_val", "end_val"]


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def test_stream_of_bars_gives_the_batch_strokes(spark, bars, tmp_path):
    """Four arrivals, each resumed from the checkpoint, one with bars seen before; some series miss an arrival."""
    src = bars.select("symbol", "idx", F.col("day").cast("timestamp").alias("ts"), "high", "low")
    path, out, stream = str(tmp_path / "bars"), str(tmp_path / "out"), None
    for lo, hi in ((0, 99), (90, 101), (102, 350), (351, 10**6)):
        part = src.filter(F.col("idx").between(lo, hi))
        part = part.filter("symbol <> '3'") if lo == 90 else part
        part = part.unionByName(src.filter("symbol = '3' and idx between 100 and 101")) if lo == 102 else part
        part.write.mode("append").parquet(path)
        stream = stream or spark.readStream.schema(src.schema).parquet(path)
        SF.upsert_strokes(SF.strokes(stream), out)
    late = {r.symbol: r.idx for r in spark.read.parquet(f"{out}/late").collect()}
    assert set(late.values()) == {10} and "3" not in late and len(late) == bars.select("symbol").distinct().count() - 1
    assert rows(SF.current_strokes(spark, out)) == rows(S.build(bars, S.StructureConfig()).strokes)
    assert spark.read.parquet(f"{out}/open-3").groupBy("symbol").count().filter("count > 3").count() == 0


def test_the_state_of_strokes_is_plain_and_short(bars):
    """Dumping and loading after every bar changes nothing, and the state does not grow with the series."""
    from barflow.operators.structure.kernel import StrokeFold

    for conf in (S.StructureConfig(), S.StructureConfig(bi_allow_sub_peak=False), S.StructureConfig(bi_strict=False, gap_as_kl=True)):
        whole, base, settled = StrokeFold(conf), 0, []
        part = StrokeFold(conf)
        for r in bars.filter("symbol = '1'").orderBy("idx").select("idx", "high", "low").collect():
            whole.push(r.idx, r.high, r.low)
            part = StrokeFold.load(conf, *part.dump())
            part.push(r.idx, r.high, r.low)
            now = [x._replace(pos=x.pos + base) for x in part.strokes()]
            n = part.settle()
            settled, base = settled + now[:n], base + n
            assert settled + now[n:] == whole.strokes()
        if conf.bi_allow_sub_peak:
            assert len(part.dump()[0]) < 200 and len(part.dump()[1]) <= 2


def test_window_strokes_equal_a_fold_of_each_window(bars):
    from barflow.operators.structure.kernel import StrokeFold

    b = bars.filter("symbol in ('1', '4')")
    got = {}
    for r in S.window_strokes(b, S.StructureConfig(), first=200, step=5, size=300).orderBy("pos").collect():
        got.setdefault(r.symbol, []).append(tuple(r)[1:])
    n_windows = 0
    for symbol in ("1", "4"):
        rows = b.filter(F.col("symbol") == symbol).orderBy("idx").select("idx", "high", "low").collect()
        for end in range(200, len(rows), 5):
            f = StrokeFold(S.StructureConfig())
            for r in rows[max(0, end - 300) : end]:
                f.push(r.idx, r.high, r.low)
            assert got.get(f"{symbol}@{end}", []) == [tuple(s) for s in f.strokes()]
            n_windows += 1
    assert len(got) == n_windows > 60


def test_window_signals_do_not_look_ahead(bars):
    """The summary of a window equals the one of its bars alone."""
    from barflow.operators import indicators as ind
    from barflow.operators.structure import points as P
    from barflow.plans import screen

    pick = ["symbol", "price", "types", "zs", "position", "stroke_cnt"]
    some = TR.window_signals(bars, first=300, step=100, size=400).filter("end = 400")
    part = ind.macd(bars).filter("idx < 400")
    s = S.build(part, S.StructureConfig.from_dict(S.config.SCREEN))
    alone = screen.summary(s, P.stroke_points(s, part), part)
    assert sorted(map(tuple, some.select(pick).collect())) == sorted(map(tuple, alone.join(some.select("symbol"), "symbol").select(pick).collect()))
    assert some.count() > 5


def test_training_round_trip(spark, bars, tmp_path):
    from barflow.session import cut
    from barflow.sources import sinks

    x = cut(TR.samples(bars, step=25, gain=0.3))
    assert len(TR.FEATURES) == 58 and set(TR.FEATURES) <= set(x.columns)
    a, b = TR.time_split(x, 0.7)
    assert a.agg(F.max("day")).first()[0] < b.agg(F.min("day")).first()[0]
    model = TR.train(a, trees=3)
    sinks.save_model(model, str(tmp_path / "m"))
    scored = TR.score(sinks.load_model(str(tmp_path / "m")), b)
    assert scored.filter("model_score NOT BETWEEN 0 AND 100").count() == 0
    m = TR.metrics(scored)
    assert 0 <= m["accuracy"] <= 1 and 0 <= m["auc"] <= 1
    assert "model_score" in TR.score(model, b.drop("bi_slope")).columns  # falls back to the rule score


def test_windows_by_count_and_the_ledger(spark, tmp_path):
    """Arrivals in any order inside a batch; bars seen before are passed over; late rows are counted exactly per series."""
    r = __import__("random").Random(2)
    path = str(tmp_path / "in")
    bars = [(s, i, float(r.randint(1, 9)), 9.0 + r.random(), r.random(), float(r.randint(1, 9)), float(i)) for s in "ab" for i in range(60)]
    stream = None
    for low, high in ((0, 25), (20, 41), (41, 60)):
        part = [b for b in bars if low <= b[1] < high]
        r.shuffle(part)
        spark.createDataFrame(part, "symbol string, idx int, open double, high double, low double, close double, volume double").coalesce(1).write.mode("append").parquet(path)
        stream = stream or spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        ST.to_folder(SF.count_windows(stream, size=12, step=4, first=8), str(tmp_path / "out"), "append")
    got = sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "out/data")).drop("epoch").collect())
    want = []
    for s in "ab":
        own = [b for b in bars if b[0] == s]
        for end in range(8, 60, 4):
            w = own[max(0, end - 12) : end]
            want.append((s, end, len(w), w[0][2], max(b[3] for b in w), min(b[4] for b in w), w[-1][5], sum(b[6] for b in w)))
    assert got == sorted(want)

    ticks, frontier, late = [], {}, {}
    base = __import__("datetime").datetime(2024, 1, 1)
    path, schema = str(tmp_path / "ticks"), "symbol string, ts timestamp, seq long, price double, volume double"
    stream = None
    for n in range(3):
        part = [(s, base + __import__("datetime").timedelta(hours=r.randint(0, 300)), n * 1000 + k, 1.0, 1.0) for k, s in enumerate("ab" * 40)]
        for s, ts, *_ in part:
            if s in frontier and (frontier[s] - ts).total_seconds() > 48 * 3600:
                late[s] = late.get(s, 0) + 1
        for s, ts, *_ in part:
            frontier[s] = max(frontier.get(s, ts), ts)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = stream or spark.readStream.schema(schema).parquet(path)
        SF.split_ledger(SF.ledger(stream, "2 days"), str(tmp_path / "ledger"))
    counts = {x["symbol"]: (x["kept"], x["late"]) for x in SF.late_counts(spark, str(tmp_path / "ledger")).collect()}
    assert counts == {s: (120 - late[s], late[s]) for s in "ab"} and min(late.values()) > 5


def test_an_arrival_is_written_by_many_tasks(spark, tmp_path):
    from barflow.registry.learning import arrivals

    df = spark.range(0, 900, 1, 6).withColumnRenamed("id", "k")
    seen = []
    for n in arrivals(df, F.col("k") % 3, 3, str(tmp_path), "in"):
        rows = [r.k for r in spark.read.parquet(str(tmp_path / "in")).collect()]
        assert sorted(rows) == [k for k in range(900) if k % 3 <= n]
        seen.append(len(list((tmp_path / "in").glob("*.parquet"))))
    assert seen[0] > 1
