"""Operations of a training-data pipeline over ``documents``, ``embeddings`` and ``pages``.

Nothing else in the library imports this subpackage.  Each module holds one operator with its own
general interface; ``queries`` derives the registered ``opN_<name>`` results from them.
"""
