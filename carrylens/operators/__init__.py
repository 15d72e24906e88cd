"""carrylens.operators."""
