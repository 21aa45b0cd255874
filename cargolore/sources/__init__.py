"""Readers and writers of reference data, shipments and reports."""
