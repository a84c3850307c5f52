"""Session settings, derived input tables and the registered queries."""
