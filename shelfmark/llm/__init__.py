"""Operators for large training-data corpora.

Nothing outside this subpackage imports it.  Each operator lives in one module with its own
general interface; the thin ``opN_*`` queries that apply an operator to a whole table are at the
end of that module and are gathered in :mod:`shelfmark.llm.registry`.
"""
