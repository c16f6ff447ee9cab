"""Readers, writers, generators and registries."""
