"""Registered queries, each an operator applied to the test tables."""
