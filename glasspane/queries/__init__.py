"""Registered queries and their SQL, by topic."""
