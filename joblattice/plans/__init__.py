"""Queries, each registered with the SQL that says the same."""

from . import asking, drilldowns, engagement, fields, finding, history, market, newsroom, pages, priced, quality, releases, rosters, streams, watching
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "asking", "drilldowns", "engagement", "fields", "finding", "history", "market", "newsroom", "pages", "priced", "quality", "releases", "rosters", "streams", "watching"]
