"""Plans that build, resolve and store the graph."""
