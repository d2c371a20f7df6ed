"""Reading documents and data sets, writing tables."""
