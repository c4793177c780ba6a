"""Named queries over the tables, each with the SQL that states its result."""
