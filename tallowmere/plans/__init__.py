"""Named queries over the star schema, each with the SQL that must give the same rows."""
