"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  Each module holds one operator with its own general
interface; :mod:`tidesort.llm.queries` derives the registered ``opN_*`` digests from them.
"""
