"""Plans of the core engine."""
