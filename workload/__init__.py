"""Queries over the shared test tables, each with its SQL twin."""

from . import (  # noqa: F401  (registration by import)
    agreement_queries,
    join_queries,
    lexicon_queries,
    money_queries,
    review_queries,
    source_queries,
    text_queries,
)
from .base import ORACLE, QUERIES  # noqa: F401
