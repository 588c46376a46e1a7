"""Stream memory, vector retrieval, corpus preparation and benchmark scoring on Spark."""

from frameweave.session import get_session

__all__ = ["get_session"]
