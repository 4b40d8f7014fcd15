"""Readers and writers of subtitle files and of the documents around them."""
