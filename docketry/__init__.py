"""Docketry: session, catalog, citation and template analytics as Spark jobs."""

from docketry.session import build_session, tune

__all__ = ["build_session", "tune"]
