"""Readers and writers for listings, WAVE files, manifests, captions and reports."""
