"""barflow: bar series, price structure, screening and text search as Spark jobs."""

from barflow.session import build_session

__all__ = ["build_session"]
