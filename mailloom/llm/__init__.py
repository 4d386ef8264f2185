"""Training-data operators: ten independent Spark jobs over a corpus of documents.

Nothing outside this subpackage imports it.
"""
