"""Readers: N-Triples text, observation documents, history, live notifications."""
