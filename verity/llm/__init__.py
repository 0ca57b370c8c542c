"""Training-data operators (one module each).  Nothing outside this package imports it."""
