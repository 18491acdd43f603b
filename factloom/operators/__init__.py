"""DataFrame operators: as-of selection, filters, facets, paging, ranking, comparison, versions, metrics."""
