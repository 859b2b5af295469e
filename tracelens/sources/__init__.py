"""Readers and writers: trace logs, transcripts, and the tables of a workspace."""
