"""Tables that the engine reads and the stores that it writes."""
