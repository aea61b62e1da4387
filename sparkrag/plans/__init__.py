"""Pipelines made of operators, models behind protocols, and registries of both."""
