"""Writers: the node table to text."""
