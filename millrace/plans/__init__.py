"""Statements, versioned tables, constraints, views, catalog and distribution."""
