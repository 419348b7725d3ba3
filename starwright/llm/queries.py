"""All queries of this subpackage by name."""

from starwright.llm.registry import QUERIES, SQL
from starwright.llm import (  # noqa: F401  (registers the queries)
    balanced_shards,
    bpe,
    exact_dedup,
    lemp,
    merkle,
    mil_quality,
    nn_descent,
    pivotal_mix,
    setsketch,
    string_kernel,
    tag_paths,
    token_orc,
    warc_revisit,
)

__all__ = ["QUERIES", "SQL"]
