"""Readers and writers of annotations, results, tracks and parameters."""
