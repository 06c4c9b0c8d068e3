"""Training-data operators over raw document tables.

Nothing else in the library imports this subpackage; it may import general
helpers (:mod:`quire.session`). Queries and their SQL are in
:mod:`quire.llm.queries` and :mod:`quire.llm.oracle`.
"""
