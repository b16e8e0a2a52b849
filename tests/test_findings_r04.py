"""What the findings of round 4 led to."""

from dataclasses import replace

from pyspark.sql import functions as F

from barflow.functions import rules as R
from barflow.operators import indicators as ind
from barflow.operators.scan import SERIES
from barflow.plans import screen


def test_an_index_on_the_edge_is_what_the_sums_give(spark):
    """13 up and 7 down are an index of exactly 30, whatever the range, and 30 is not above 30."""
    rows = []
    for w in (3, 9, 12, 16, 22, 30, 58):
        low = 100000.0
        for i, (lo, hi) in enumerate([(low, low + w), (low, low + w + 13), (low - 7, low + w + 13)]):
            rows.append((f"r{w}", i, low + 1, hi, lo, low + 2, 10.0))
    bars = spark.createDataFrame(rows, "symbol string, idx int, open double, high double, low double, close double, volume double")
    x = screen.last_bar(ind.price_features(bars, replace(SERIES, partial=True))).withColumn("zs_breakout_dir", F.lit(0.0))
    out = x.withColumn("score", R.feature_score()).collect()
    assert [r.adx for r in out] == [30.0] * 7
    assert {r.score for r in out} == {70}


def test_windows_are_built_slice_by_slice(spark, bars, monkeypatch):
    """Slices of the series hold all of them once, and the files of one are gone before the next begins; the result's alone stay."""
    from glob import glob

    from barflow.plans import training as TR
    from barflow.session import checkpoint_dir, cut

    folder = checkpoint_dir(spark).removeprefix("file://")
    files = lambda: {p for p in glob(f"{folder}/**/part-*", recursive=True)}
    before, left = files(), []

    def build(b):
        left.append(len([p for p in files() - before if "/slices-" not in p]))
        return cut(b.select("symbol", F.col("idx") + 1, "day", "close"))

    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(TR.in_slices(bars, build, most=1500)) == rows(bars.select("symbol", F.col("idx") + 1, "day", "close"))
    assert len(left) > 3 and set(left) == {0}
    assert rows(TR.in_slices(bars.limit(0), build)) == []
    before = files()
    windows = TR.window_signals(bars, first=400, step=100)
    assert windows.count() > 10 and len(windows.select("symbol").distinct().collect()) == 10
    assert all("/out/" in p for p in files() - before)


def test_large_files_are_hashed_piece_by_piece(spark, tmp_path, monkeypatch):
    """Files of any content have the hash, path and size that reading them whole gives, also where they are split."""
    import gzip
    import hashlib
    import random

    from barflow.plans import knowledge as K

    rnd = random.Random(5)
    files = {
        "noise.bin": rnd.randbytes(300_000), "ended.txt": b"a\r\nb\n\n" * 20_000, "open.txt": b"x\n" * 50_000 + b"y", "marked.md": b"\xef\xbb\xbf" + b"line\n" * 30_000, "marked open.md": b"\xef\xbb\xbf" + b"line\n" * 30_000 + b"z",
        "one line.svg": b"\0" * 200_000, "ends.txt": b"\n" * 100_000, "packed.gz": gzip.compress(rnd.randbytes(150_000)), "small.txt": b"few",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        whole = {r.path: tuple(r) for r in K.inventory(spark, str(tmp_path)).collect()}
        streamed = {r.uri: r.sha256 for r in K.streamed_hashes(spark, str(tmp_path), 50_000).collect()}
        pieced = {r.path: tuple(r) for r in K.inventory(spark, str(tmp_path), whole=50_000).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert pieced == whole and len(streamed) == 7
    assert {p.rsplit("/", 1)[-1]: x[3] for p, x in pieced.items()} == {n: hashlib.sha256(c).hexdigest() for n, c in files.items()}
