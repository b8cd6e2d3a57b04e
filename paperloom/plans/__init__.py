"""Plans of the page-retrieval engine."""
