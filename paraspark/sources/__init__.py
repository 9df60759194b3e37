"""Input tables."""
