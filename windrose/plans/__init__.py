"""Registered queries, their SQL, and runs."""
