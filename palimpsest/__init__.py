"""Palimpsest: finds, masks, restores and audits sensitive values in text and JSON, on DataFrames."""
