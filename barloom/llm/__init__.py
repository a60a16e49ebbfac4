"""Operators for preparing text corpora: cleaning, deduplication, scans, packing, sharding, binary output."""
