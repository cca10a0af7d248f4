"""Readers of manifests, listings, YAML and Markdown documents, outlines and version snapshots."""
