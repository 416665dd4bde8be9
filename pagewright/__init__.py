"""Spark jobs for page recognition output: features, candidates, layout, text repair, question mining."""
