"""Reading, paging and writing tables."""
