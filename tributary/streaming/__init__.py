"""Incremental variants of the feed and of the delivery sink."""
