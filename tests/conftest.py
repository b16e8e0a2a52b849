import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from barflow import build_session

    session = build_session("tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def bars(spark, sf):
    from barflow.sources.tables import walk_bars

    return walk_bars(spark, sf).cache()


@pytest.fixture(scope="session")
def structure(spark, bars):
    from barflow.operators import structure as S

    return S.build(bars, S.StructureConfig.from_dict(S.config.SCREEN))


@pytest.fixture(scope="session")
def points(structure, bars):
    from barflow.operators import indicators as ind
    from barflow.operators.structure import points as P
    from barflow.session import cut

    return cut(P.stroke_points(structure, ind.macd(bars)))


def series(spark, closes, symbol="s", spread=1.0):
    rows = [(symbol, i, float(c), float(c) + spread, float(c) - spread, float(c), 10.0 + i % 7) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, idx int, open double, high double, low double, close double, volume double")
