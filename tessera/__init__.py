"""tessera: a Spark-native engine that turns a scholarly knowledge graph (resource and
statement tables) into curated question-answering datasets and scores predictions on them.

Every operator is either ``DataFrame -> DataFrame`` (usable with ``df.transform``) or
``Column -> Column``.  Nothing is collected to the driver except one-row results and
bounded size checks.
"""

__version__ = "0.1.0"


def _ship_code_with_tasks() -> None:
    """Python functions of this package that run inside tasks (the title score, flat-map
    callbacks) are pickled by value, so executors need no installed copy of the package."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except (ImportError, AttributeError, ValueError):  # pragma: no cover - older pyspark
        pass


_ship_code_with_tasks()
