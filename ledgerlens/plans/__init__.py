"""The metric algebra, its checker and compiler."""
