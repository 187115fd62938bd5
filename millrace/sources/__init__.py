"""Scans, document readers, file listings and the staging folder."""
