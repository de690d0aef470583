"""Operators for preparing large training corpora, each re-expressed as a Spark plan.

Nothing else in the library imports this subpackage.  Every operator takes and returns
DataFrames; models and small statistics are fitted on the driver, texts never are.
"""
