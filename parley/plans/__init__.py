"""Bindings of the supplied tables and the registered queries."""
