"""Structure results shared by the queries of one session, so each dataset is folded once."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from barflow.operators import indicators as ind
from barflow.operators import structure as S
from barflow.operators.structure import points as P
from barflow.session import cut, cut_in_place
from barflow.sources import tables as T


@lru_cache(maxsize=2)
def _bars(app: str, sf: str) -> DataFrame:
    """The walk bars, read by the fold, the strengths and what is shown beside the structure."""
    return cut_in_place(T.walk_bars(SparkSession.getActiveSession(), sf))


@lru_cache(maxsize=8)
def _built(app: str, sf: str, items: tuple) -> S.Structure:
    return S.build(_bars(app, sf), S.StructureConfig.from_dict(dict(items)))


@lru_cache(maxsize=8)
def _points(app: str, sf: str, items: tuple, level: str) -> DataFrame:
    s = _built(app, sf, items)
    return cut(P.stroke_points(s, ind.macd(s.bars)) if level == "stroke" else P.segment_points(s))


def structure(spark: SparkSession, sf: str, conf: dict | None = None) -> S.Structure:
    return _built(spark.sparkContext.applicationId, sf, tuple(sorted((conf or S.config.SCREEN).items())))


def points(spark: SparkSession, sf: str, conf: dict | None = None, level: str = "stroke") -> DataFrame:
    return _points(spark.sparkContext.applicationId, sf, tuple(sorted((conf or S.config.SCREEN).items())), level)
