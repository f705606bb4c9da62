"""DataFrame operators: matching, fusion, merge, graph, vectors, metrics."""
