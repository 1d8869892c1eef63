"""senarai: text-review analytics expressed as PySpark DataFrame plans."""
