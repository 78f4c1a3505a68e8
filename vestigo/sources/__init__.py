"""Readers and writers of the tables, logs and files the jobs work on."""
