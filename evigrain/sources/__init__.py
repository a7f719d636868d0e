"""Readers, writers and the checks that go with them."""
