"""feedworks: turn messy daily feeds into trustworthy Spark tables."""
