"""Readers, writers and the adapters that derive the logical inputs from star-schema tables."""
