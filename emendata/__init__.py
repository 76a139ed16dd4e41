"""Text-correction and corpus analytics as PySpark DataFrame operators."""
