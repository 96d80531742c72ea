"""Training-data operators: one module for each, and the query modules that apply them to whole tables."""
