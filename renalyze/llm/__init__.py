"""Training-data operators: quality, language, toxicity, deduplication,
tokenising and packing of a ``documents`` table.

Every operator is a module of its own with a general interface; the thin
registered queries are in ``renalyze.llm.queries``.  Nothing else in the
package imports this subpackage.
"""
