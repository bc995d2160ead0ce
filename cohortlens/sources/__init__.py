"""Reading source tables, dataset contracts and sinks."""
