"""Column-level building blocks: parsing, statistics, exact ranks, calendar periods."""
