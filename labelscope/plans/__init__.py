"""Workflows, derived tables and registered queries."""
