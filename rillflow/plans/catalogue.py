"""All registered queries: importing the modules registers theirs."""

from . import queries, runs  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
