"""Loads: staged reloads, truncates, appends, purges, clones, run records."""
