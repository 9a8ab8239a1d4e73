"""All registered corpus queries: one per operator over its whole table, and the pipeline, with SQL where it can say the same."""

from mosaiq.llm import queries_layout, queries_links, queries_texts  # noqa: F401
from mosaiq.llm.registry import ORACLES, QUERIES  # noqa: F401
