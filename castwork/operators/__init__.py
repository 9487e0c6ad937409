"""castwork.operators."""
