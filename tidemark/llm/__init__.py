"""Training-data operators: ten batch operators and what they share.

Nothing outside this package imports it.
"""
