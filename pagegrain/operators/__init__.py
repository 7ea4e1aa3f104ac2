"""Jobs over whole tables: aggregations, revisions, assignment, validation, upkeep."""
