"""Sequential algorithms on one domain, as plain numpy and Python functions."""
