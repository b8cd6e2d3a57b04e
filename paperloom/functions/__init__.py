"""Functions of the page-retrieval engine."""
