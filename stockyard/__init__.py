"""Store-inventory analytics as plain PySpark DataFrame functions."""
