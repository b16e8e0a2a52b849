"""Headline timings: python bench.py prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from barflow import build_session  # noqa: E402
from barflow.operators import indicators as ind  # noqa: E402
from barflow.operators import structure as S  # noqa: E402
from barflow.operators.structure import points as P  # noqa: E402
from barflow.plans import context, screen  # noqa: E402
from barflow.registry import text as TX  # noqa: E402
from barflow.plans import knowledge as K  # noqa: E402
from barflow.session import cut  # noqa: E402
from barflow.sources import tables as T  # noqa: E402


def tick_bars(spark, sf):
    return T.price_bars(spark, sf)


def walk_bars(spark, sf):
    return T.walk_bars(spark, sf)


def moving_averages(spark, sf):
    from barflow.operators.scan import SERIES

    b = T.walk_bars(spark, sf)
    return b.select("symbol", "day", *[ind.sma(SERIES, t).alias(f"ma{t}") for t in (5, 20, 60)])


def macd(spark, sf):
    return ind.macd(T.walk_bars(spark, sf))


def features(spark, sf):
    return ind.price_features(T.walk_bars(spark, sf))


def merged(spark, sf):
    return S.merged_bars(T.walk_bars(spark, sf))


def structure(spark, sf):
    return S.build(T.walk_bars(spark, sf), S.StructureConfig.from_dict(S.config.SCREEN)).lines


def points(spark, sf):
    b = cut(T.walk_bars(spark, sf))
    s = S.build(b, S.StructureConfig.from_dict(S.config.SCREEN))
    return P.stroke_points(s, ind.macd(b))


def full_scan(spark, sf):
    return screen.ranked(screen.full_scan(spark, sf)).filter("rank <= 15")


def sector_heat(spark, sf):
    return context.sector_heat(T.quotes(T.walk_bars(spark, sf)), T.universe(spark, sf))


def text_search(spark, sf):
    return K.search(TX.docs(spark, sf), TX.kb_queries(spark, sf))


def page_chunks(spark, sf):
    return TX.chunks(spark, sf)


QUERIES = [tick_bars, walk_bars, moving_averages, macd, features, merged, structure, points, full_scan, sector_heat, text_search, page_chunks]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark: SparkSession = build_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    # start the JVM, the scan path and the Python workers before timing
    run(T.load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity")))
    spark.range(8).repartition(8).mapInPandas(lambda it: it, "id long").count()
    times: dict[str, float] = {}
    only = set(sys.argv[1:])
    for fn in QUERIES:
        if only and fn.__name__ not in only:
            continue
        t0 = time.perf_counter()
        run(fn(spark, sf))
        times[fn.__name__] = round(time.perf_counter() - t0, 3)
        print(fn.__name__, times[fn.__name__], file=sys.stderr, flush=True)
    symbols = T.load(spark, sf, "supplier").count()
    out = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}
    if "full_scan" in times:
        out["scan_symbols_per_sec"] = round(symbols / times["full_scan"], 1)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
