"""Scans: raw payload, document and snapshot text to typed rows."""
