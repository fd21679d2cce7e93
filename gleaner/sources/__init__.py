"""Readers for landed feed / API payloads and the file sinks."""
