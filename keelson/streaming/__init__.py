"""Change streams: tails, watches, gaps, replicas, and a live view."""
