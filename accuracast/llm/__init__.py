"""Operators that prepare text and web records for training language models.

The project's own records are panels of numbers; its only free text is what users attach to a series.
Operators that need text therefore take any table with an identifier and a text column and name both as
parameters. Nothing outside this folder imports it.
"""
