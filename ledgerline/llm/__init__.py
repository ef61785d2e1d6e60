"""Operations for large training-data corpora, as Spark jobs.

Nothing else in the library imports this subpackage.  Each module offers a
general operator; :mod:`ledgerline.llm.registry` derives the registered
queries from them.
"""
