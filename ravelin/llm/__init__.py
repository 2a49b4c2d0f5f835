"""Training-data operators: every module is self-contained and nothing else in ravelin imports it."""
