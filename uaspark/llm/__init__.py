"""Training-data operators: sharding, tokenising, PII, quality, language, near
and exact copies, mixing, language-model scores and vector search.

Each module holds one operator with its own interface; ``queries`` registers the
``opN_<name>`` queries over the shared tables.  Nothing else in the package
imports this subpackage.
"""
