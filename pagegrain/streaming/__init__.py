"""Revision ingest as a stream."""
