"""Tables: where rows come from and what they can narrow before they are read."""
