"""Sessions, staging of intermediate tables and other plan-level helpers."""
