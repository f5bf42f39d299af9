"""Operators that prepare training data. Nothing else in the package imports this folder.

Every operator reads only the columns it names, so tables may carry any other columns. A missing
text counts as empty unless the operator says otherwise.
"""
