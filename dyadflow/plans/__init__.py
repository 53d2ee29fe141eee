"""Registered queries over the driver tables and their ANSI-SQL counterparts."""
