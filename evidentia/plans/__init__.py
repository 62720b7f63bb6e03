"""Named queries: input tables to result, with the SQL each is checked against."""
