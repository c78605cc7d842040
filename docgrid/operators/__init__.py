"""Relational operators over documents, pages, outlines and elements."""
