"""The log parser on a stream."""
