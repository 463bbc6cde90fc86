"""Registered queries over the generic test tables, and the SQL they are checked against."""
