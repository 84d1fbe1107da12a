"""Importing this module registers the queries of the package."""

from traceframe.llm import embedding_dedup, jaccard_join, language_id, lexical_search, packing, pseudonyms, quality_model, quality_rules, sentencepiece_codec, sharding, toxicity, vector_codes, warc_bundles  # noqa: F401
from traceframe.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
