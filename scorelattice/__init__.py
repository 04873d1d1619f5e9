"""Score-evidence tables on Spark: extract, resolve, admit, rank and audit."""
