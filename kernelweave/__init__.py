"""kernelweave: a PySpark-native engine for text logic, graphs and record refinery."""
