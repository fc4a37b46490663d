"""Column functions of the queue formats."""
