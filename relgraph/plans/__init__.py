"""plans of relgraph."""
