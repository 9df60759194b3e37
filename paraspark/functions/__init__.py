"""Spark SQL expression builders: formula chemistry and null-safe arithmetic.

Every function takes SQL text (a column name or an expression) and returns SQL
text for ``selectExpr``/``F.expr``. One parsed string per column keeps plan
building cheap; Catalyst sees the same expression tree either way.
"""
