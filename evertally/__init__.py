"""Exact, replay-safe event counting as Spark DataFrame operators."""
