"""paperloom: Spark-native analytics around business documents.

Operators are DataFrame -> DataFrame functions; scalar rules are Column -> Column
functions. ``queries`` binds both to the Parquet tables of a directory.
"""
