"""Named relational reports: seven investigations and eighteen dashboard extracts."""
