"""Queries over the driver tables, each next to the SQL it must agree with."""
