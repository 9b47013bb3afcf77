"""treelens: DataFrame queries over versioned, content-addressed trees.

Subpackages
-----------
sources     table scans and the derived relations the operators share
functions   Column-level scalar functions
operators   relational operators (history, diff, usage, packs, access, ...)
plans       operator registry: query functions and their oracle SQL
streaming   Structured Streaming operators and their batch twins
"""

__version__ = "0.1.0"
