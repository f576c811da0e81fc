"""Named queries over the test tables, with the SQL that an independent engine runs for the same rows."""
