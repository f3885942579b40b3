"""wardflow: hospital-operations analytics as PySpark DataFrame functions."""
