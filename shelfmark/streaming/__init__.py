"""Batch by batch and streaming ingestion."""
