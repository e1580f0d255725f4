"""Resumable loads as micro-batches."""
