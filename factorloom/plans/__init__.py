"""How SGD is laid out over partitions."""
