"""DataFrame operators: reduction, ordering, sparse vectors, graphs, generators."""
