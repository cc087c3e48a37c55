"""Declarative load plans: column mappings and one spec per target table."""
