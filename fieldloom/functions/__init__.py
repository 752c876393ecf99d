"""Column functions and the few Arrow helpers they need."""
