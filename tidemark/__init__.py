"""Document tables and corpus operators expressed as Spark DataFrame plans."""
