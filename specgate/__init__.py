"""specgate: certificate-conformance operators on PySpark DataFrames."""
