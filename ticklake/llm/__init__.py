"""Training-data operators: ten document, page and vector operators and the
corpus pipeline built from them.  Nothing outside this package imports it.
"""
