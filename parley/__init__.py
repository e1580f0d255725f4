"""Batch jobs for analysing chat conversations with Spark."""
