"""Training-data operators. Nothing outside this package and its tests imports it."""
