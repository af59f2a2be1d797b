"""Incremental processing, beyond what the declarations need."""
