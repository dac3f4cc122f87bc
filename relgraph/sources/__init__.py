"""Sources and sinks: the revisioned store, tuple files, validation files and the graph of the star schema."""
