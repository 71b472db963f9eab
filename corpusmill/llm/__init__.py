"""Training-data operators.

Nothing outside this subpackage imports it.  ``corpusmill.llm.registry`` holds
the registered queries and their SQL oracles.
"""
