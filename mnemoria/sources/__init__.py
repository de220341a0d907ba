from .tables import full_key, load, read_tables

__all__ = ["full_key", "load", "read_tables"]
