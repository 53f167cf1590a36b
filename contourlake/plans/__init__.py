"""Whole plans: the session interface and the registered queries."""
