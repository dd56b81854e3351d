"""Tables and files read by the engine."""
