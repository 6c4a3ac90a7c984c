"""Readers: tables as corpora, file trees, written bundles."""
