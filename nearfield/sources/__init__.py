"""Snapshots on disk and the JSON requests of the store's two endpoints."""
