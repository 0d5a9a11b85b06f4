"""Readers and writers: index tables, labels, listings, manifests, statistics, chunked training sets."""
