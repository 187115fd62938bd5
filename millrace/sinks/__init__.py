"""Table creation, writes, verified writes and partition-wise merges."""
