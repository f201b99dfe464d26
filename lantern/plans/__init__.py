"""The registered queries of the library."""

from . import checks, corpus, lookups, ranking, relational, texts  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
