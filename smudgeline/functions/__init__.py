"""Column-to-column functions: everything here stays inside one row."""
