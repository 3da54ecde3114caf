"""DataFrame-in, DataFrame-out steps of a consolidation."""
