"""Query dialects and the registered queries."""
