"""operators of relgraph."""
