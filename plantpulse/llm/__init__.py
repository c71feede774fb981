"""Operators for training-data pipelines: filters, deduplication, decontamination, packing, sharding."""
