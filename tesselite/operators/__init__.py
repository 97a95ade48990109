"""Resolution of records into entities, as grouped aggregations."""
