"""Statistical-file analytics for PySpark: SAS, Stata and SPSS files as DataFrames."""
