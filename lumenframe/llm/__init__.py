"""Training-data operators: each module holds one operator and its own docstring of edge cases."""
