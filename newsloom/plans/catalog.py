"""All named queries and their SQL."""

from __future__ import annotations

from newsloom.plans import base, candidates, dictionaries, edited, editorial, judging, pages, ranked, states, streams, texts

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "candidates", "dictionaries", "edited", "editorial", "judging", "pages", "ranked", "states", "streams", "texts"]
QUERIES, ORACLES = base.QUERIES, base.ORACLES
FLAGSHIP = ranked.front_page
