"""Readers and writers of the documents that the stages exchange."""
