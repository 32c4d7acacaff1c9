"""Operators for preparing training text: every module is one operator over DataFrames."""
