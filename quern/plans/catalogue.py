"""All queries of the library but those of training data, and their SQL."""

from quern.plans import retrieval, symbolic, text

QUERIES = {**retrieval.QUERIES, **text.QUERIES, **symbolic.QUERIES}
ORACLES = {**retrieval.ORACLES, **text.ORACLES, **symbolic.ORACLES}
