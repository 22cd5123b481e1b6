"""Column functions and the registry of statistic keys."""
