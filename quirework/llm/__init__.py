"""Training-data operators: each module holds one operator with its DataFrame interface.

Nothing else in the library imports this subpackage; ``llm.queries`` registers
the thin queries that apply the operators to whole tables.
"""
