"""Retrieval over claim texts: chunkers, lexical and dense search, rank fusion."""
