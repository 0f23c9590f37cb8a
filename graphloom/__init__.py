"""Graph, history and corpus analytics as PySpark DataFrame operators."""
