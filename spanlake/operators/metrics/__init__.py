"""Scoring metrics as DataFrame aggregations."""
