"""Flows that chain several operators."""
