"""Streams.  All record functions look at one row, so they work on a stream as they are; no state is kept."""
