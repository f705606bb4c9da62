"""Session settings, shared tables and the registered queries."""
