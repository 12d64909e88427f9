"""Writers of graphs."""
