"""Search, join, lifecycle and neighbour-graph operators."""
