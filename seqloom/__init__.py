"""seqloom: sequence analytics expressed as Spark plans."""
