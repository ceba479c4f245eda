"""Column-level building blocks: dictionary matching and text scalars."""
