"""DataFrame-to-DataFrame operators: joins, windows, groupings and grids."""
