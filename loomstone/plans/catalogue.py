"""Named queries and, for each that SQL can express, its SQL."""

from __future__ import annotations

from loomstone.plans import registry
from loomstone.plans import accounting, attention, coding, dictionaries, files, headers, packing, rates, relational, sequences, similarity, state, streams, vectors  # noqa: F401  they register their queries

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
