"""castwork.streaming."""
