"""Following the change log as a stream."""
