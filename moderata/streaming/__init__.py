"""Running the row-wise operators on a stream of files."""
