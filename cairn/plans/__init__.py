"""Named queries over the data folders, and the SQL they are checked against."""
