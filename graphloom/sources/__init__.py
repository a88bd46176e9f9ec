"""Readers, writers and versioned stores."""
