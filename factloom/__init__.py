"""factloom: document-facts analytics expressed as Spark DataFrame plans."""
