from gridtide.catalog.core import REGISTRY
from gridtide.catalog import align, features, models, reports, streams, tables  # noqa: F401

__all__ = ["REGISTRY"]
