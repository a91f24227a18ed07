"""Import every module that registers queries."""

from stancepanel.plans import corpus_queries, io_queries, panel_queries, token_queries  # noqa: F401
from stancepanel.plans.registry import QUERIES, oracles  # noqa: F401
