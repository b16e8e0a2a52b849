"""ML and STM rows."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from barflow.plans import training as TR
from barflow.registry.core import query, r
from barflow.registry.prelude import HOURS, with_bars
from barflow.registry.structure import HOUR_STROKES
from barflow.session import checkpoint_dir, cut
from barflow.sources import tables as T
from barflow.streaming import bars as ST
from barflow.streaming import stateful as SF

GAIN = 0.3  # the walk bars move about 0.2 % a day, so the label threshold is scaled down
LABELS = """, lb AS (SELECT symbol, day, idx, CASE WHEN (coalesce(lead(close, 5) OVER w, last_value(close) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / close - 1) * 100 > 0.3 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY idx))
"""


def labelled(spark, sf):
    return T.walk_bars(spark, sf).withColumn("label", TR.label(gain=GAIN))


@query("ml02_labels", with_bars(LABELS + " SELECT symbol, day, label FROM lb"))
def labels(spark, sf):
    return labelled(spark, sf).select("symbol", "day", "label")


@query("agg16_prevalence", with_bars(LABELS + " SELECT round(avg(label), 6) AS prevalence, round(greatest(1.0, (count(*) - sum(label)) / greatest(sum(label), 1.0)), 6) AS weight FROM lb"))
def prevalence(spark, sf):
    c = TR.class_weight(labelled(spark, sf))
    return c.select(r("prevalence", 6), r("weight", 6))


@query("ml03_time_split", with_bars(LABELS + ", e AS (SELECT quantile_disc(day, 0.8) AS edge FROM bars) SELECT symbol, day, day <= edge AS is_train FROM lb, e"))
def time_split(spark, sf):
    a, b = TR.time_split(labelled(spark, sf))
    return a.select("symbol", "day", F.lit(True).alias("is_train")).unionByName(b.select("symbol", "day", F.lit(False).alias("is_train")))


_SAMPLES: dict = {}


def samples(spark, sf):
    """Built once per session and dataset: the windows multiply the bars by size / step."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SAMPLES:
        _SAMPLES[key] = TR.samples(T.walk_bars(spark, sf), gain=GAIN)
    return _SAMPLES[key]


_MODELS: dict = {}


def saved_model(spark, sf):
    """The model of a dataset, trained once per session on the earlier days and read back from the shared folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        path = f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
        TR.train(cut(TR.time_split(samples(spark, sf))[0])).write().save(path)
        _MODELS[key] = path
    return PipelineModel.load(_MODELS[key])


@query("ml01_samples")
def training_samples(spark, sf):
    return samples(spark, sf)


@query("ml04_06_train_and_score")
def train_and_score(spark, sf):
    return TR.score(saved_model(spark, sf), TR.time_split(samples(spark, sf))[1]).select("symbol", "day", "label", "prediction", "model_score")


@query("ml05_metrics")
def model_metrics(spark, sf):
    """AUC and accuracy on the later days."""
    got = TR.metrics(TR.score(saved_model(spark, sf), TR.time_split(samples(spark, sf))[1]))
    return spark.createDataFrame(sorted((k, float(v)) for k, v in got.items()), "metric string, value double")


@query("rule03_model_or_rule")
def model_or_rule(spark, sf):
    """The saved model's score; every seventh row lacks a feature and falls back to the rule score."""
    x = samples(spark, sf).withColumn("rsi", F.when(F.xxhash64("symbol", "day") % 7 != 0, F.col("rsi")))
    return TR.model_or_rule(saved_model(spark, sf), x).select("symbol", "day", "score", "origin")


@query("stm02_window_signals")
def window_signals(spark, sf):
    """What each trailing window of the training set showed at its end."""
    return TR.window_signals(T.walk_bars(spark, sf)).select("symbol", "end", "price", "is_buy", "types", "zs", "position", "signal")


def folder(spark) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def event_ticks(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))


@query("stm08_tumbling_bars", "WITH " + HOURS + " SELECT symbol, ts, open, high, low, close, volume FROM hbars")
def tumbling(spark, sf):
    path = folder(spark)
    ST.to_folder(ST.tumbling(event_ticks(spark, sf)), path)
    return ST.newest(spark, path, ["symbol", "ts"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stm09_sliding_bars", "WITH s AS (SELECT event_type AS symbol, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS ts, ts AS t, event_id, value FROM events) SELECT symbol, ts, arg_min(value, row(t, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(t, event_id)) AS close, count(*)::DOUBLE AS volume FROM s GROUP BY 1, 2")
def sliding(spark, sf):
    path = folder(spark)
    ST.to_folder(ST.tumbling(event_ticks(spark, sf), "2 days", slide="1 day"), path)
    return ST.newest(spark, path, ["symbol", "ts"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "stm09_count_windows",
    with_bars("""
SELECT e.symbol, e.idx AS "end", count(*)::INTEGER AS n, arg_min(b.open, b.idx) AS open, max(b.high) AS high, min(b.low) AS low, arg_max(b.close, b.idx) AS close, sum(b.volume) AS volume
FROM bars e JOIN bars b ON b.symbol = e.symbol AND b.idx BETWEEN e.idx - 300 AND e.idx - 1 WHERE e.idx >= 200 AND (e.idx - 200) % 5 = 0 GROUP BY e.symbol, e.idx"""),
)
def count_windows(spark, sf):
    """Windows of 300 bars at every fifth bar from bar 200; the bars arrive in three parts."""
    path = folder(spark)
    b = T.walk_bars(spark, sf).select("symbol", "idx", "open", "high", "low", "close", "volume")
    for _ in arrivals(b, F.least(F.floor(F.col("idx") / 190), F.lit(2)), 3, path, "bars"):
        ST.to_folder(SF.count_windows(spark.readStream.schema(b.schema).parquet(f"{path}/bars")), path, "append")
    return spark.read.parquet(f"{path}/data").select("symbol", "end", "n", "open", "high", "low", "close", "volume")


def arrivals(df, part, parts, path, name):
    """Write rows as `parts` arrivals, each of as many files as there are tasks, and stop after each for the stream to take it.

    The rows are made once and kept by part, so an arrival only copies its own."""
    marked = df.withColumn("_part", part.cast("int"))
    marked.write.partitionBy("_part").parquet(f"{path}/staged")
    staged = df.sparkSession.read.schema(marked.schema).parquet(f"{path}/staged")
    for n in range(parts):
        staged.filter(F.col("_part") == n).drop("_part").write.mode("append").parquet(f"{path}/{name}")
        yield n


LATE = """m AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, event_id % 3 AS part FROM events),
fr AS (SELECT symbol, part, max(max(ts)) OVER (PARTITION BY symbol ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS frontier FROM m GROUP BY symbol, part),
marked AS (SELECT m.*, frontier IS NOT NULL AND ts < frontier - INTERVAL 9 DAY AS late FROM m JOIN fr USING (symbol, part))
"""


def ledger(spark, sf):
    """Three arrivals, each over the whole time; rows more than nine days behind their series' newest one are late."""
    path = folder(spark)
    e = T.load(spark, sf, "events")
    t = e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    for _ in arrivals(t, F.col("seq") % 3, 3, path, "ticks"):
        SF.split_ledger(SF.ledger(spark.readStream.schema(t.schema).parquet(f"{path}/ticks"), "9 days"), path)
    return path


@query("stm03_late_ledger", "WITH " + LATE + " SELECT symbol, count_if(NOT late) AS kept, count_if(late) AS late FROM marked GROUP BY symbol")
def late_ledger(spark, sf):
    return SF.late_counts(spark, ledger(spark, sf))


@query("stm03_tumbling_of_kept", "WITH " + LATE + " SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, row(ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, seq)) AS close, count(*)::DOUBLE AS volume FROM marked WHERE NOT late GROUP BY 1, 2")
def tumbling_of_kept(spark, sf):
    path = ledger(spark, sf)
    kept = spark.readStream.schema(spark.read.parquet(f"{path}/kept").schema).parquet(f"{path}/kept/*")
    ST.to_folder(ST.tumbling(kept.select("symbol", "ts", "seq", "price", "volume")), f"{path}/bars")
    return ST.newest(spark, f"{path}/bars", ["symbol", "ts"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stm07_sessions", "SELECT event_type AS symbol, ts::DATE AS day, count(*)::DOUBLE AS total_vol, count_if(strftime(ts, '%H%M') >= '0930' AND strftime(ts, '%H%M') <= '1000')::DOUBLE AS morning, count_if(strftime(ts, '%H%M') > '1430' AND strftime(ts, '%H%M') < '1500')::DOUBLE AS tail FROM events GROUP BY 1, 2")
def stream_sessions(spark, sf):
    path = folder(spark)
    ST.to_folder(ST.sessions(event_ticks(spark, sf)), path)
    return ST.newest(spark, path, ["symbol", "day"])


@query("stm03_unique_bars", "SELECT DISTINCT event_type AS symbol, date_trunc('hour', ts) AS ts FROM events")
def unique(spark, sf):
    path = folder(spark)
    e = event_ticks(spark, sf).withColumn("ts", F.date_trunc("hour", "ts")).select("symbol", "ts")
    ST.to_folder(ST.unique_bars(e), path, "append")
    return spark.read.parquet(f"{path}/data").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stm06_price_alerts", "WITH p AS (SELECT event_type AS symbol, round(avg(value), 2) AS cost FROM events GROUP BY 1), a AS (SELECT e.event_id AS seq, e.event_type AS symbol, round((e.value - cost) / cost * 100, 2) AS pnl_pct FROM events e JOIN p ON p.symbol = e.event_type) SELECT seq, symbol, CASE WHEN pnl_pct >= 15 THEN 'take_profit' ELSE 'stop_loss' END AS alert FROM a WHERE pnl_pct >= 15 OR pnl_pct <= -8")
def price_alerts(spark, sf):
    path = folder(spark)
    pos = T.load(spark, sf, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.round(F.avg("value"), 2).alias("cost")).withColumn("qty", F.lit(1))
    ST.to_folder(ST.price_alerts(event_ticks(spark, sf), pos), path, "append")
    return spark.read.parquet(f"{path}/data").select("seq", "symbol", F.col("alerts")[0].alias("alert"))


@query("stm01_05_stroke_stream", HOUR_STROKES)
def stroke_stream(spark, sf):
    """The hourly bars arrive week by week; each arrival resumes the stream from its checkpoint."""
    from barflow.operators.scan import numbered

    path = folder(spark)
    h = numbered(T.hour_bars(spark, sf), F.date_trunc("month", "ts")).select("symbol", "idx", "ts", "high", "low")
    for week in range(5):
        h.filter(F.floor((F.dayofmonth("ts") - 1) / 7) == week).write.mode("append").parquet(f"{path}/bars")
        stream = spark.readStream.schema(h.schema).parquet(f"{path}/bars")
        SF.upsert_strokes(SF.strokes(stream), path)
    return SF.current_strokes(spark, path)


@query("stm04_parent_child_join", "WITH " + HOURS + " SELECT symbol, ts + INTERVAL 1 HOUR AS child_end, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS parent_end FROM hbars")
def parent_child(spark, sf):
    path = folder(spark)
    h = T.hour_bars(spark, sf).select("symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("end_ts"))
    d = T.hour_bars(spark, sf).select("symbol", F.date_trunc("day", "ts").alias("start_ts")).distinct().withColumn("end_ts", F.col("start_ts") + F.expr("INTERVAL 1 DAY"))
    h.write.parquet(f"{path}/kids")
    d.write.parquet(f"{path}/parents")
    kids, parents = (spark.readStream.schema(x.schema).parquet(f"{path}/{n}") for x, n in ((h, "kids"), (d, "parents")))
    ST.to_folder(ST.children_of(parents, kids, "1 day"), path, "append")
    return spark.read.parquet(f"{path}/data").select("symbol", F.col("child_end").cast("timestamp_ntz").alias("child_end"), F.col("parent_end").cast("timestamp_ntz").alias("parent_end"))
