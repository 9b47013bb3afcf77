"""Training-data operators: dedup, tokens, filters, scoring, mixing, sharding.

Each module holds one operator with its own general interface; ``queries``
derives the fixed digest columns of the registered ``opN_`` queries from them.
Nothing outside this subpackage imports it.
"""
