"""All core queries by name."""

from __future__ import annotations

from graphloom.plans import general, reference

QUERIES = {**reference.QUERIES, **general.QUERIES}
SQL = {**reference.SQL, **general.SQL}
FLAGSHIP = "ask_lexical"
