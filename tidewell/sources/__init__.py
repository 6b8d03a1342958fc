"""Readers: stored tables, JSON documents and file manifests."""
