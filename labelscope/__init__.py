"""Machine-made annotations of documents, analysed with PySpark."""
