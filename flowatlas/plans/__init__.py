"""Registered queries, the tables they are bound to, and their SQL."""
