"""Operators of a training-data pipeline over documents, pages and conversations.

Each module holds one operator with its own interface; ``queries`` registers
them over the driver's tables.  Nothing else in the library imports this
subpackage."""
