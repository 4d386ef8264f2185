"""Column functions over message text and metrics."""
