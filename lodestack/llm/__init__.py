"""Training-data operators. Nothing else in lodestack imports this subpackage."""
