"""Named queries wired from the operators, with their SQL twins."""
