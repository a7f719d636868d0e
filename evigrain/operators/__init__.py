"""Batch operators over corpus tables."""
