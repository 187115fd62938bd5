"""Column functions: keys, templates, JSON settings and times."""
