"""memlattice: a Spark-native engine for conversational memory.

Every operator takes and returns DataFrames; nothing is collected inside an
operator unless its size has a stated bound.
"""
