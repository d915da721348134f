"""Training-data operators: quality, near-duplicates, decontamination, tokens, language, toxicity, HTML.

Nothing else in the library imports this subpackage. ``fathom.llm.registry`` holds the queries and the
SQL oracles that ``__spark_entry__.py`` registers when the subpackage is present.
"""
