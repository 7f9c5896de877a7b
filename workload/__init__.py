"""Inputs derived from the driver's tables, the registered queries and their oracles."""
