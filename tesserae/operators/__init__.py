"""Operators over tables: corpus building, chunking, retrieval, answering, evaluation."""
