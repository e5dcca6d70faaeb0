"""Readers: trees, repositories, the versioned store."""
