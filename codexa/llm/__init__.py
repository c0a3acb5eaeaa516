"""Training-data operators: fingerprints, tokenisers, deduplication, scoring, packing.

Nothing outside this subpackage imports it. ``queries()`` and ``oracles()`` feed
``__spark_entry__.py``.
"""


def queries():
    """Name -> callable(spark, sf_dir) for the ten operators."""
    from codexa.llm import registry

    return registry.queries()


def oracles():
    """Name -> DuckDB SQL for those operators that SQL can express."""
    from codexa.llm import registry

    return registry.oracles()
