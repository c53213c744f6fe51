"""The registered queries of the graph engine and their DuckDB oracles."""

from lodegraph.plans import catalog_gql, catalog_graph, catalog_more

QUERIES: dict = {**catalog_gql.QUERIES, **catalog_graph.QUERIES, **catalog_more.QUERIES}
ORACLES: dict = {**catalog_gql.ORACLES, **catalog_graph.ORACLES, **catalog_more.ORACLES}
