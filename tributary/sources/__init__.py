"""Readers for exports and declared schemas."""
