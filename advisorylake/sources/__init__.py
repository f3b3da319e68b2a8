"""Landed raw documents -> MENTION_SCHEMA or catalogue frames, and report sinks."""
