"""Named queries, their SQL twins, and staged runs."""
