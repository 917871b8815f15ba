"""Readers and writers: file trees, images, versioned tables, append-only logs."""
