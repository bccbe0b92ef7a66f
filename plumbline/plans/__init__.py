"""Plan helpers: lineage cuts, hot-key joins and scan layout."""
