"""Named queries over the tables of one folder, with their SQL twins."""
