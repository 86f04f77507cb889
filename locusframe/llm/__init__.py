"""Training-data pipeline operators.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general interface; ``queries``
derives the contract columns from the operators and registers them under ``opN_<name>``.
"""
