"""One module for each registered query: its contract columns and, where there is one, its SQL."""
