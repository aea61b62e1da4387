"""Operators for building large text corpora for language-model training.

Nothing outside this subpackage imports it. Every module holds one operator; ``queries`` holds the
thin queries that apply them to the standard tables, with the SQL that checks them.
"""
