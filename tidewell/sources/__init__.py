"""Readers that turn files and text logs into typed DataFrames."""
