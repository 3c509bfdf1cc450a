"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; its queries are registered through
:mod:`quillframe.llm.queries`.
"""
