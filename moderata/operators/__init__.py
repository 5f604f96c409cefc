"""Table operators: ``DataFrame -> DataFrame`` functions."""
