"""Reading, writing and generating sets of points."""
