"""Batch operators over parsed logs."""
