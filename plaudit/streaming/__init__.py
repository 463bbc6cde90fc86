"""Row-wise operators on a stream."""
