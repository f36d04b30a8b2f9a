"""Jobs that chain operators and keep versioned stage outputs."""
