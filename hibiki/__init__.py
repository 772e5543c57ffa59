"""hibiki: retrieval, evaluation and operations analytics as lazy PySpark DataFrame operators."""
