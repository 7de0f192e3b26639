"""Readers and writers: tables, span fixtures, OTLP requests, taxonomies."""
