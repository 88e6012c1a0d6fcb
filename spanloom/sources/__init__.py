"""Readers and writers: QA corpora, nested JSON, text corpora, features, reports."""
