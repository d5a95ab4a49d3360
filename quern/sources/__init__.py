"""Readers and writers: corpora of files, instance lists, cached tables, results."""
