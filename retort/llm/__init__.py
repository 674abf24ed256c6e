"""Operators for preparing language-model training data on Spark.

One module per operator (``qualify``, ``substrings``, ``reshard``, ``setjoin``,
``htmltext``, ``decontaminate``, ``secrets``, ``packing``, ``toxicity``,
``chatlogs``); ``queries`` registers one query for each of them.
"""
