"""carrylens.sources."""
