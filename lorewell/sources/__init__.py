"""Readers and writers of the tables of the knowledge base."""
