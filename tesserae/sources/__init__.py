"""Readers and writers, and the seams to models and services."""
