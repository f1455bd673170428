"""Text privacy engine for Spark: find, score, mask, restore and report personal data."""

__version__ = "0.1.0"
