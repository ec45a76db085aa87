"""The engine and its native and row plans."""
