"""Readers, writers and the views that adapt the test tables to the jobs."""
