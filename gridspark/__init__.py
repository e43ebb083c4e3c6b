"""Analytics on gridded fields as Spark tables."""

from .model import GridError, GridSet  # noqa: F401
