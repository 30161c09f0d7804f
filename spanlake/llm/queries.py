"""All queries of the package: importing the modules registers them."""

from spanlake.llm import q_corpus, q_search  # noqa: F401
from spanlake.llm.registry import ORACLE, QUERIES  # noqa: F401
