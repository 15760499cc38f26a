"""Named queries over the star-schema tables, each with its SQL twin where one exists."""

from . import alignment, claims, curves, decisions, files, interactions, models, pairing, scalars, streaming  # noqa: F401
from .registry import oracle_sql, queries  # noqa: F401
