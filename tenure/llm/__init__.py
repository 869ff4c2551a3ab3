"""Training-data operators: archives, quality, deduplication, redaction, packing.

Nothing else in the library imports this subpackage.  Every operator is a
function from DataFrames to a DataFrame; ``queries.py`` applies each one to
its whole table under the name ``opN_<name>``.
"""
