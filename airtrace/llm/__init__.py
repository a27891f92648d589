"""Training-data operators. ``queries`` holds what the driver registers."""
