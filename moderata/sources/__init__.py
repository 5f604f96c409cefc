"""Readers, the dataset registry, and the index, model and metrics stores."""
