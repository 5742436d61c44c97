"""Readers, writers, the session filter and the enriched fact."""
