"""Readers, writers and model stores."""
