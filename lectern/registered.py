"""All registered queries: importing the modules that define them fills the two tables."""

from __future__ import annotations

from lectern import queries_contract, queries_matched, queries_numbers, queries_pages, queries_rules, queries_tables  # noqa: F401
from lectern.queries import QUERIES, SQL  # noqa: F401
