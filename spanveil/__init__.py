"""Span analytics for personal data in text, on Spark."""
