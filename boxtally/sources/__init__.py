"""Readers, writers and the table contracts they enforce."""
