"""Column functions: latency buckets, SQL texts, log texts and levels, small derived values."""
