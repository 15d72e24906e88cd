"""carrylens.plans."""
