"""acervo: a master-data and corpus analytics library on PySpark."""
