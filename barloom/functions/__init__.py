"""Column builders: pure ``Column -> Column`` helpers that stay inside Catalyst."""
