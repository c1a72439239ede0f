"""All queries of this package and their SQL; importing it registers them."""

from docloom.llm import backoff, chat, codes, containment, crf, ordinal, packing, prefixes, private, repeats, superminhash, templates, warc  # noqa: F401
from docloom.llm.tables import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
