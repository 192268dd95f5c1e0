"""Training-data operators: ten jobs over whole tables of documents and pages.

Nothing outside this folder imports it. Every operator takes a DataFrame and the
names of its id and text columns and reads nothing else of it, so further columns,
clashing names included, do no harm.
"""
