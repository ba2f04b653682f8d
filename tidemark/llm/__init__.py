"""Operators of a training-data pipeline: counting, cleaning, deduplicating and encoding documents.

Every operator takes a DataFrame of documents and the names of its id and text columns, and looks at no
other column, so further columns of any name do no harm. Unless an operator says otherwise, a null text
counts as an empty one, a row with a null id keeps its row, repeated rows are repeated in the result, and
an empty table gives an empty result of the same columns.
"""
