from . import ieee, scalars  # noqa: F401
