"""Training-data operators. Nothing else in logloom imports this subpackage."""
