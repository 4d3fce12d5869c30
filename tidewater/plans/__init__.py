"""Query registry and plan-level helpers."""
