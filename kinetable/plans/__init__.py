"""Queries over the tables, with the SQL they are compared with."""
