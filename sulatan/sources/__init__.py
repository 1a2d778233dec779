"""Readers and writers: word lists, replies, file listings, logs, archives."""
