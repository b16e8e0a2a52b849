"""What the findings of round 3 led to."""

from pyspark.sql import functions as F

from barflow.operators import indicators as ind
from barflow.operators import structure as S
from barflow.operators.scan import SERIES
from barflow.plans import screen
from barflow.session import cut, cut_in_place, in_place, placed


def test_windows_share_the_folds_that_agree(bars, monkeypatch):
    """Trailing windows push a bar once for all of them that stand at the same stroke (F1)."""
    from barflow.operators.structure import replay
    from barflow.operators.structure.kernel import StrokeFold

    held = {}

    class Rows:
        def mapInArrow(self, run, schema):
            held["run"] = run

    pushes = 0
    push = StrokeFold.push

    def counted(self, *bar):
        nonlocal pushes
        pushes += 1
        push(self, *bar)

    b = bars.filter("symbol = '1'").select("symbol", "idx", "high", "low").orderBy("idx").toArrow()
    monkeypatch.setattr(replay, "sorted_bars", lambda _: Rows())
    monkeypatch.setattr(StrokeFold, "push", counted)
    S.window_strokes(None, S.StructureConfig(), first=200, step=5, size=300)
    rows = sum(x.num_rows for x in held["run"](iter(b.to_batches())))
    alone = sum(min(end, 300) for end in range(200, b.num_rows, 5))
    assert rows > 0 and pushes < alone / 2


def test_placed_tables_meet_without_a_shuffle(spark):
    """Tables of one series stay together through joins, windows and groups."""
    x = spark.range(200).select((F.col("id") % 7).cast("string").alias("symbol"), F.col("id").cast("int").alias("idx"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    with in_place(spark):
        a, b = cut(placed(x)), cut(placed(x.withColumn("v", F.col("idx") * 2)))
        met = a.join(b, ["symbol", "idx"]).groupBy("symbol", "idx").agg(F.max("v").alias("v"))
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
        assert met.count() == 200
    assert spark.conf.get("spark.sql.adaptive.enabled") == before


def test_features_of_the_last_bar_need_its_reach_only(bars):
    """The last bar's features come from the rows its frames reach, and are those of the whole series."""
    both = []
    for last in (None, ind.REACH):
        x = ind.price_features(bars, last=last).withColumns(ind.volume_price(SERIES))
        both.append(sorted(map(tuple, screen.last_bar(x).collect())))
    assert both[0] == both[1] and len(both[0]) > 5
    kept = ind.price_features(bars, last=ind.REACH).groupBy("symbol").count().agg(F.max("count")).first()[0]
    assert kept == ind.REACH


def test_bars_written_in_place_are_not_moved_again(spark, bars):
    """The fold and the strengths read the written bars where they lie."""
    from barflow.operators.structure.tables import sorted_bars

    b = cut_in_place(bars)
    with in_place(spark):
        for x in (sorted_bars(b), ind.macd(b)):
            assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()


def test_snippets_lower_the_text_once(spark, capsys):
    """A row's text is lower-cased once, however many needles there are, and odd texts have their snippets."""
    from barflow.functions import text as X

    rows = [("a" * 100 + " Needle in HAY " + "b" * 200, "none", ["zz", "needle", "hay"]), ("short", "", ["x"]), ("", "q", []), (None, "q", ["q"])]
    df = spark.createDataFrame(rows, "text string, query string, terms array<string>")
    out = df.select(X.snippet(F.col("text"), F.col("query"), F.col("terms")).alias("s"))
    start = 101 - 60
    assert [r["s"] for r in out.collect()] == ["..." + rows[0][0][start : start + 180] + "...", "short", "", None]
    out.explain()
    assert capsys.readouterr().out.count("lower(text") == 1


def test_bars_move_to_their_series_once(spark, sf):
    """Behind the order ranges of a day the bars are shuffled once, to their series."""
    from barflow.sources import tables as T

    with in_place(spark):
        # other ranges than those of `bars`, which other tests have cached
        plan = placed(T.walk_bars(spark, sf, 19))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_columns_become_lists_as_pylist_gives_them():
    """Columns without nulls take the short way to lists, and every column has the values it had."""
    import pyarrow as pa

    from barflow.operators.columns import values

    given = [
        pa.array([1, 2**40, -3]), pa.array([1, None], pa.int32()), pa.array([0.5, -0.0, float("inf")]), pa.array([None, 0.1]), pa.array([True, False]), pa.array([None, True]),
        pa.array(["a", "", "a", "ü"]), pa.array(["a", None]), pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([[1], None]), pa.array(["x", "y", "y", "z"]).slice(1, 2), pa.array([1, 2, 3]).slice(1, 1),
    ]
    for column in given:
        out = values(column)
        assert out == column.to_pylist() and [type(v) for v in out] == [type(v) for v in column.to_pylist()]
    nan = values(pa.array([float("nan"), 1.0]))
    assert nan[0] != nan[0] and nan[1] == 1.0


def test_strengths_of_settled_strokes_read_the_shared_bars(spark, sf, monkeypatch):
    """The bars are built once, and they meet the strokes where they lie."""
    from barflow.registry import shared
    from barflow.registry import structure as R
    from barflow.sources import tables as T

    built = []
    walk = T.walk_bars
    monkeypatch.setattr(T, "walk_bars", lambda *a: built.append(1) or walk(*a))
    shared._bars.cache_clear(), shared._built.cache_clear()
    out = R.settled_strengths(spark, sf)
    assert len(built) == 1 and out.count() > 0
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
