"""Queries, pipelines and the registry of plug-ins."""
