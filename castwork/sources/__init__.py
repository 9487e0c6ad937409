"""castwork.sources."""
