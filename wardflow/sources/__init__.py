"""Declared schemas, table readers, sinks and the derived test tables."""
