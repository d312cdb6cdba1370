"""larder: product-data coding and analytics expressed as Spark DataFrame plans."""
