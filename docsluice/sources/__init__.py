"""Readers, writers and provider slots."""
