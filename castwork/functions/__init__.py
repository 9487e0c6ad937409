"""castwork.functions."""
