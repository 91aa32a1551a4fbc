"""Stateful message streams."""
