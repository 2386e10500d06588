"""Plans: windows, bucketing, the choice of source, and the query API."""
