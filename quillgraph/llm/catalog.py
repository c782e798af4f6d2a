"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from quillgraph.llm import chat, embeddings, licenses, media, mixing, packing, quality, simhash, urls, warc

MODULES = (chat, embeddings, licenses, media, mixing, packing, quality, simhash, urls, warc)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}
