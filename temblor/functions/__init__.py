"""Column expressions: no shuffle, no action, usable in any select."""
