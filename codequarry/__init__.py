"""codequarry: code-repository intelligence and text-corpus operators on PySpark DataFrames."""
