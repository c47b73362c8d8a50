"""All queries of this subpackage: importing the modules registers them."""

from rtq.llm import decontaminate, language_id, licenses, mixing, near_dups, quality, repair, sharding, substrings, suffix_runs, url_rules, warc, whitening  # noqa: F401
from rtq.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
