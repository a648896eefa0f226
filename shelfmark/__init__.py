"""A Spark engine that turns product pages into validated, queryable catalog records."""
