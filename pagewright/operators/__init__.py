"""Operators on tables of pages, words, lines and questions."""
