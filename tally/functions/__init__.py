"""Column functions: period labels, money and text formatting."""
