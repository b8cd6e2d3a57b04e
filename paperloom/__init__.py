"""paperloom: page retrieval, evidence packing and retrieval evaluation on PySpark."""
