"""Column functions: all are built from the engine's own expressions, none calls Python for a row."""
