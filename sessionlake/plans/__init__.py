"""Query specifications and the plans they lower to."""
