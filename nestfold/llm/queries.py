"""All queries of this subpackage, with their SQL where SQL can say it."""

from nestfold.llm.base import ORACLES, QUERIES
from nestfold.llm import (  # noqa: F401
    alignment, bpe, chat, licenses, line_dedup, minhash, mixing, packing, quality_model, quality_rules,
    topk, toxicity, trie)

__all__ = ["ORACLES", "QUERIES"]
