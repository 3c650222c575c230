"""Views of a box: plans of pieces, and their execution."""
