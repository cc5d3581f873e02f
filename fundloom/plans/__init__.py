"""The queries of the library by family, each with its SQL twins."""

from fundloom.plans import analytics, catalogue, documents, ingest, learning, portfolios, reports

FAMILIES = (analytics, catalogue, documents, ingest, learning, portfolios, reports)
