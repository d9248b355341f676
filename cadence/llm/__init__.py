"""Training-data operators: extraction, filtering, deduplication, privacy,
mixing, packing and sharding of text corpora.

Each module holds one operator with its own general interface; ``queries``
binds them to the driver's tables.  Nothing else in the library imports this
subpackage.
"""
