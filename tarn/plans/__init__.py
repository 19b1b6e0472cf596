"""Plan-level helpers: shared scratch tables and session settings."""
