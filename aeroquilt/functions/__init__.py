"""Column functions: geodesy, cameras, radiometry, parameters."""
