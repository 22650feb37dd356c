"""Readers, writers and versioned table stores."""
