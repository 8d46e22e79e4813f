"""Corpus preparation for language-model training: ten operators and their driver queries."""
