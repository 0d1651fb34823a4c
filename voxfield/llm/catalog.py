"""Queries over the training-data operators, and the SQL that states the same result."""

from voxfield.llm import (  # noqa: F401
    q_bond,
    q_bpe,
    q_mixing,
    q_mtree,
    q_orderminhash,
    q_overlap,
    q_pitmanyor,
    q_quality,
    q_runs,
    q_simhash,
    q_substring,
    q_toxicity,
    q_urls,
)
from voxfield.llm.registry import QUERIES, SQL  # noqa: F401
