"""Jobs with a command line; each keeps its work in a function that takes a session."""
