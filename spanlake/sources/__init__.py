"""Readers, writers, row identity and the views built on the driver's tables."""
