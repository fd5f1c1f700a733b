"""Jobs that chain operators end to end, and the registry of checked queries."""
