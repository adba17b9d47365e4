"""Ready-made queries on the star schema and the SQL that gives the same result."""
