"""Operators for building training corpora: similarity joins, filters, packing, mixing, search.

Each module holds one operator with a general interface; ``queries`` registers
one query per operator.  Nothing outside this package imports it.
"""
