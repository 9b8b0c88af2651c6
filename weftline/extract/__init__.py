"""Symbols, imports and calls of source texts: a registry of language scanners and the operator that runs them."""

from weftline.extract.registry import LanguageAdapter, extract, get, languages, register

__all__ = ["LanguageAdapter", "extract", "get", "languages", "register"]
