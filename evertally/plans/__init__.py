"""Registered queries: the operators applied to the `events` table, with their SQL oracles."""
