"""Training-data operators: text, archive and vector jobs on Spark.

Nothing else in the library imports this subpackage. ``catalog`` registers
one query per operator.
"""
