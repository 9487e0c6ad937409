"""castwork.plans."""
