"""Evidence adjudication and large-corpus analytics expressed as Spark DataFrame plans."""
